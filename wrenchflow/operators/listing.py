"""Scans, searches, ordering, paging and distinct.

Paging: ``paginate`` is ``ORDER BY ... OFFSET o LIMIT n`` which Spark plans
as a bounded top-(o+n) (``TakeOrderedAndProject``), never a full sort to one
task; for deep pages ``keyset_page`` filters on the sort key instead, which
Parquet statistics can prune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.functions.exprs import hhmm, initials, stock_flag
from wrenchflow.functions.predicates import contains_ci
from wrenchflow.operators.enrich import _owners, bookings_enriched
from wrenchflow.sources.tables import Garage


def schedule_scan(g: Garage) -> DataFrame:
    """Projection id, date, time, status; newest date first, time ascending."""
    return (g.bookings.select("id", "booking_date", "start_min", hhmm("start_min").alias("booking_time"), "status")
            .orderBy(F.col("booking_date").desc_nulls_first(), F.col("start_min").asc_nulls_last(), "id"))


def search_bookings(g: Garage, term: str, literal: bool = False) -> DataFrame:
    """P2 (contract routine ``search_bookings``): J1 rows whose customer or service name contains ``term``."""
    return bookings_enriched(g).where(contains_ci(["customer_name", "service_name"], term, literal))


def search_services(g: Garage, term: str | None = None, category: str | None = None,
                    featured: bool | None = None) -> DataFrame:
    """Services by text in name or description, category, featured flag."""
    s = g.services
    if term:
        s = s.where(contains_ci(["name", "description"], term))
    if category:
        s = s.where(F.col("category") == category)
    if featured is not None:
        s = s.where(F.col("featured") == F.lit(featured))
    return s.withColumn("in_stock", stock_flag("stock")).orderBy("category", "name", "id")


def search_vehicles(g: Garage, term: str) -> DataFrame:
    """Vehicles whose plate or VIN contains ``term``, with owner name."""
    return (g.vehicles.where(contains_ci(["license_plate", "vin"], term))
            .join(_owners(g), F.col("customer_id") == F.col("_cid"), "left")
            .select("id", "customer_id", "make", "model", "year", "license_plate", "vin",
                    F.col("customer_name").alias("owner_name")))


def search_users(g: Garage, term: str | None = None, roles: list[str] | str | None = None) -> DataFrame:
    """Users by text in name or e-mail and by role (scalar or list)."""
    u = g.users
    if term:
        u = u.where(contains_ci(["name", "email"], term))
    if roles:
        u = u.where(F.col("role").isin(*([roles] if isinstance(roles, str) else roles)))
    return u.withColumn("initials", initials("name")).orderBy("name", "id")


def vehicles_by_customer(g: Garage) -> DataFrame:
    """Every customer's vehicles, ordered by customer, make, model."""
    return g.vehicles.where(F.col("customer_id").isNotNull()).orderBy("customer_id", "make", "model", "id")


def availability_by_mechanic(g: Garage) -> DataFrame:
    """Weekly windows per mechanic by weekday."""
    a = g.mechanic_availability
    return (a.select("mechanic_id", "day_of_week", "start_min", "end_min",
                     hhmm("start_min").alias("start_time"), hhmm("end_min").alias("end_time"))
            .orderBy("mechanic_id", "day_of_week", "start_min"))


def visible_bookings(g: Garage, principals: DataFrame | None = None) -> DataFrame:
    """Which bookings each principal may see, as (user_id, role, booking_id, scope).

    A customer sees its own bookings (scope ``own``), a mechanic the ones
    assigned to it (``assigned``); both are equi-joins.  admin / staff /
    owner see everything: one row with ``booking_id`` NULL and scope
    ``all`` instead of a principal-times-bookings product.
    ``principals``: user_id, role; default all users.
    """
    p = principals if principals is not None else g.users.select(F.col("id").alias("user_id"), "role")
    b = g.bookings.select(F.col("id").alias("booking_id"), "customer_id", "mechanic_id")
    cust = (p.where(F.col("role") == "customer")
            .join(g.customers.select(F.col("id").alias("customer_id"), F.col("user_id").alias("_u")),
                  F.col("user_id") == F.col("_u"))
            .join(b, "customer_id").select("user_id", "role", "booking_id", F.lit("own").alias("scope")))
    mech = (p.where(F.col("role") == "mechanic")
            .join(g.mechanics.select(F.col("id").alias("mechanic_id"), F.col("user_id").alias("_u")),
                  F.col("user_id") == F.col("_u"))
            .join(b, "mechanic_id").select("user_id", "role", "booking_id", F.lit("assigned").alias("scope")))
    staff = p.where(F.col("role").isin("admin", "staff", "owner")).select(
        "user_id", "role", F.lit(None).cast("string").alias("booking_id"), F.lit("all").alias("scope"))
    return cust.unionByName(mech).unionByName(staff)


def row_access_filter(df: DataFrame, principal_id, role: str, g: Garage) -> DataFrame:
    """P12 for one principal: the rows of a bookings-shaped ``df`` it may see."""
    if role in ("admin", "staff", "owner"):
        return df
    if role == "customer":
        ids = g.customers.where(F.col("user_id") == F.lit(principal_id)).select(F.col("id").alias("_k"))
        return df.join(ids, F.col("customer_id") == F.col("_k"), "left_semi")
    if role == "mechanic":
        ids = g.mechanics.where(F.col("user_id") == F.lit(principal_id)).select(F.col("id").alias("_k"))
        return df.join(ids, F.col("mechanic_id") == F.col("_k"), "left_semi")
    return df.limit(0)


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 10) -> DataFrame:
    """L3: page ``page`` (1-based) of ``size`` rows in ``order``."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def keyset_page(df: DataFrame, key: str, after=None, size: int = 10, descending: bool = False) -> DataFrame:
    """L3 for deep pages: rows strictly after ``after`` on a unique sort key."""
    c = F.col(key)
    if after is not None:
        df = df.where(c < F.lit(after) if descending else c > F.lit(after))
    return df.orderBy(c.desc() if descending else c.asc()).limit(size)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """L2: ``ORDER BY ... LIMIT k`` (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def service_categories(g: Garage) -> DataFrame:
    """``SELECT DISTINCT category ORDER BY category``."""
    return g.services.select("category").where(F.col("category").isNotNull()).distinct().orderBy("category")


def uniqueness_check(incoming: DataFrame, stored: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Flag incoming rows whose key is used by another stored row or repeats in the batch.

    Both flags come from grouped counts joined back (map-side partial
    aggregation), so a key held by a third of the rows is never gathered in
    one task.  ``taken_by_other``: some stored row with this key has a
    different id.
    """
    st = stored.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(
        F.count("*").alias("_n"), F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"))
    batch = incoming.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_bk")).agg(F.count("*").alias("_bn"))
    j = (incoming.join(st, F.col(key) == F.col("_k"), "left")
         .join(batch, F.col(key) == F.col("_bk"), "left"))
    other = (F.col("_n") > 1) | (F.col("_lo") != F.col(id_col)) | (F.col("_hi") != F.col(id_col))
    return (j.withColumn("taken_by_other", F.coalesce(other, F.lit(False)))
            .withColumn("duplicate_in_batch", F.coalesce(F.col("_bn") > 1, F.lit(False)))
            .drop("_k", "_n", "_lo", "_hi", "_bk", "_bn"))


def bookings_page(g: Garage, order: list[Column], page: int = 1, size: int = 10) -> DataFrame:
    """L1 + L3 over J1, cut before enriching.

    Rows J1's inner joins would drop (no service, customer/user or vehicle)
    are removed with key-only semi joins; the page is then taken on the
    narrow booking rows (bounded top-(offset+size)), and only those rows are
    enriched -- the wide joins see ``size`` rows instead of the whole table.
    ``order`` may only use booking columns.
    """
    from wrenchflow.operators.enrich import customer_names
    b = (g.bookings
         .join(g.services.select(F.col("id").alias("_s")), F.col("service_id") == F.col("_s"), "left_semi")
         .join(customer_names(g).select(F.col("id").alias("_c")), F.col("customer_id") == F.col("_c"), "left_semi")
         .join(g.vehicles.select(F.col("id").alias("_v")), F.col("vehicle_id") == F.col("_v"), "left_semi"))
    return bookings_enriched(g, paginate(b, order, page, size))
