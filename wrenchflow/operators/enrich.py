"""Enrichment, semi and anti joins.

All joins are equi-joins.  No ``broadcast()`` hint is placed on a table whose
size grows with the data (services, customers, users, vehicles all do at
scale); Spark's size check (``autoBroadcastJoinThreshold``, re-evaluated by
AQE on runtime statistics) broadcasts a side only when it is small, and
falls back to a shuffled join otherwise.  Skewed keys in the big side are
split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchflow.functions.exprs import hhmm
from wrenchflow.functions.predicates import Date, _d
from wrenchflow.sources.tables import Garage


# --- shared dimension views -----------------------------------------------

def customer_names(g: Garage) -> DataFrame:
    """customers JOIN users: id, user_id, name, email, phone, address."""
    u = g.users.select(F.col("id").alias("_uid"), "name", "email")
    return (g.customers.join(u, F.col("user_id") == F.col("_uid"))
            .select("id", "user_id", "name", "email", "phone", "address"))


def mechanic_names(g: Garage) -> DataFrame:
    """mechanics JOIN users: id, user_id, name, status, specialization, ..."""
    u = g.users.select(F.col("id").alias("_uid"), "name", "email", F.col("status").alias("user_status"))
    return (g.mechanics.join(u, F.col("user_id") == F.col("_uid"))
            .select("id", "user_id", "name", "email", "user_status", "specialization",
                    "experience", "phone", "rating"))


def _services(g: Garage) -> DataFrame:
    return g.services.select(F.col("id").alias("_sid"), F.col("name").alias("service_name"),
                             F.col("price").alias("service_price"),
                             F.col("description").alias("service_description"),
                             "estimated_time", F.col("category").alias("service_category"))


def _owners(g: Garage) -> DataFrame:
    return customer_names(g).select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"),
                                    F.col("phone").alias("customer_phone"),
                                    F.col("email").alias("customer_email"))


def _vehicles(g: Garage) -> DataFrame:
    return g.vehicles.select(F.col("id").alias("_vid"), "make", "model", "year", "license_plate")


def _mechanic_labels(g: Garage) -> DataFrame:
    return mechanic_names(g).select(F.col("id").alias("_mid"), F.col("name").alias("mechanic_name"))


# --- J1..J3 listings ---------------------------------------------------------

def bookings_enriched(g: Garage, bookings: DataFrame | None = None) -> DataFrame:
    """Booking rows with service, customer, vehicle and mechanic names.

    INNER joins to services, customers/users and vehicles, LEFT joins to the
    mechanic.  As in the reference the joined ``customer_name`` (user name)
    and ``mechanic_id`` (mechanics.id, NULL when unmatched) replace the
    booking's own columns (T20).
    """
    b = (bookings if bookings is not None else g.bookings).drop("customer_name")
    b = b.withColumnRenamed("mechanic_id", "_b_mechanic_id")
    out = (b.join(_services(g), F.col("service_id") == F.col("_sid"))
           .join(_owners(g), F.col("customer_id") == F.col("_cid"))
           .join(_vehicles(g), F.col("vehicle_id") == F.col("_vid"))
           .join(_mechanic_labels(g), F.col("_b_mechanic_id") == F.col("_mid"), "left"))
    return (out.withColumn("mechanic_id", F.col("_mid"))
            .withColumn("booking_time", hhmm("start_min"))
            .drop("_sid", "_cid", "_vid", "_mid", "_b_mechanic_id", "service_description",
                  "service_category", "estimated_time", "customer_email"))


def order_newest_first(df: DataFrame) -> DataFrame:
    """L1 for listings: date DESC, time DESC, id as tie-breaker."""
    return df.orderBy(F.col("booking_date").desc_nulls_first(), F.col("start_min").desc_nulls_first(),
                      F.col("id").asc_nulls_last())


def joinable(g: Garage, bookings: DataFrame, vehicle: bool = False) -> DataFrame:
    """``bookings`` whose service, customer (with its user) and, if asked, vehicle exist: semi joins on keys only."""
    owners = g.customers.join(g.users.select(F.col("id").alias("_uid")), F.col("user_id") == F.col("_uid"), "left_semi")
    out = (bookings.join(g.services.select(F.col("id").alias("_sid")), F.col("service_id") == F.col("_sid"), "left_semi")
           .join(owners.select(F.col("id").alias("_cid")), F.col("customer_id") == F.col("_cid"), "left_semi"))
    if vehicle:
        out = out.join(g.vehicles.select(F.col("id").alias("_vid")), F.col("vehicle_id") == F.col("_vid"), "left_semi")
    return out


def todays_bookings(g: Garage, as_of: Date) -> DataFrame:
    """J1 restricted to one date, by start time."""
    day = g.bookings.where(F.col("booking_date") == _d(as_of))
    return bookings_enriched(g, day).orderBy(F.col("start_min").asc_nulls_last(), "id")


def recent_bookings(g: Garage, n: int = 10) -> DataFrame:
    """Newest ``n`` bookings that have a customer and a service, with their names (top-k).

    Key-only semi joins come before the cut, so a booking that the name joins
    would drop takes no place.
    """
    b = joinable(g, g.bookings.select("id", "booking_date", "status", "total_price", "customer_id", "service_id"))
    top = b.orderBy(F.col("booking_date").desc_nulls_first(), F.col("id").desc()).limit(n)
    return (top.join(_owners(g), F.col("customer_id") == F.col("_cid"))
            .join(_services(g), F.col("service_id") == F.col("_sid"))
            .select("id", "booking_date", "status", "total_price", "customer_name", "service_name"))


# --- J4..J9 mechanics and tasks -------------------------------------------

def mechanic_roster(g: Garage, active: bool = True) -> DataFrame:
    """Mechanics with their user name; active users only unless ``active=False``."""
    m = mechanic_names(g)
    if active:
        m = m.where(F.col("user_status") == "active")
    return m.select("id", "user_id", "name", "email", F.col("user_status").alias("status"),
                    "specialization", "experience")


def mechanic_tasks_view(g: Garage, mechanic_id: int | None = None, date: Date | None = None,
                        status: str | None = None) -> DataFrame:
    """Tasks INNER-joined to their booking, service, customer and vehicle."""
    t = g.mechanic_tasks.select(F.col("id").alias("task_id"), F.col("booking_id").alias("_bid"),
                                F.col("mechanic_id").alias("task_mechanic_id"),
                                F.col("status").alias("task_status"),
                                F.col("start_min").alias("task_start_min"),
                                F.col("end_min").alias("task_end_min"))
    if mechanic_id is not None:
        t = t.where(F.col("task_mechanic_id") == mechanic_id)
    if status and status != "all":
        t = t.where(F.col("task_status") == status)
    b = g.bookings.select("id", "booking_date", "start_min", F.col("status").alias("booking_status"),
                          "service_id", "customer_id", "vehicle_id")
    if date is not None:
        b = b.where(F.col("booking_date") == _d(date))
    return (t.join(b, F.col("_bid") == F.col("id"))
            .join(_services(g), F.col("service_id") == F.col("_sid"))
            .join(_owners(g), F.col("customer_id") == F.col("_cid"))
            .join(_vehicles(g), F.col("vehicle_id") == F.col("_vid"))
            .select("task_id", F.col("id").alias("booking_id"), "task_mechanic_id", "task_status",
                    "task_start_min", "task_end_min", "booking_date", "start_min", "booking_status",
                    "service_name", "service_price", "estimated_time", "customer_id",
                    "customer_name", "make", "model", "license_plate"))


def mechanic_tasks_outer(g: Garage, status: str | None = None, start: Date | None = None,
                         end: Date | None = None) -> DataFrame:
    """Every assigned booking with its task if started (all mechanics at once).

    LEFT join on the compound key (booking id AND mechanic) so unstarted work
    shows with NULL task columns; a status filter applies to the task status
    in WHERE, which (as in the reference) turns the join effectively inner.
    """
    return _assigned(g, status, start, end)


def _assigned(g: Garage, status: str | None = None, start: Date | None = None, end: Date | None = None,
              notes: DataFrame | None = None) -> DataFrame:
    """Assigned bookings with their task, service, customer and vehicle, and pages of ``notes`` (_nb, ...) if given.

    Rows are moved once for their task (and notes), once for the service and once for customer and vehicle together: a customer comes again with
    the same few vehicles, so their pairs are looked up apart, as rows of two keys.
    """
    b = g.bookings.where(F.col("mechanic_id").isNotNull())
    if start is not None and end is not None:
        b = b.where(F.col("booking_date").between(_d(start), _d(end)))
    b = b.select("id", "mechanic_id", "booking_date", "start_min", F.col("status").alias("booking_status"),
                 "service_id", "customer_id", "vehicle_id", F.col("notes").alias("customer_notes"))
    t = g.mechanic_tasks.select(F.col("id").alias("task_id"), F.col("booking_id").alias("_tb"),
                                F.col("mechanic_id").alias("_tm"), F.col("status").alias("task_status"),
                                F.col("start_min").alias("task_start_min"),
                                F.col("end_min").alias("task_end_min"))
    pairs = (b.select(F.col("customer_id").alias("_pc"), F.col("vehicle_id").alias("_pv")).distinct()
             .join(_owners(g), F.col("_pc") == F.col("_cid")).join(_vehicles(g), F.col("_pv") == F.col("_vid"))
             .select("_pc", "_pv", "customer_name", "make", "model", "license_plate"))
    mine = F.col("mechanic_id") == F.col("_tm")
    if notes is not None:  # no key of the join: tasks and notes both go by booking alone
        mine = (F.col("mechanic_id") <= F.col("_tm")) & (F.col("mechanic_id") >= F.col("_tm"))
    out = b.join(t, (F.col("id") == F.col("_tb")) & mine, "left")
    if status and status != "all":
        out = out.where(F.col("task_status") == status)
    more = []
    if notes is not None:
        out, more = out.join(notes, F.col("id") == F.col("_nb"), "left"), [c for c in notes.columns if c != "_nb"]
    return (out.join(_services(g), F.col("service_id") == F.col("_sid"))
            .join(pairs, (F.col("customer_id") == F.col("_pc")) & (F.col("vehicle_id") == F.col("_pv")))
            .select("id", "mechanic_id", "booking_date", "start_min", "booking_status", "service_name",
                    "service_price", "estimated_time", "customer_id", "customer_name", "make", "model",
                    "license_plate", "task_id", "task_status", "task_start_min", "task_end_min",
                    "customer_notes", *more))


def field_notes_enriched(g: Garage) -> DataFrame:
    """Field notes with booking, service, customer, vehicle and mechanic name."""
    n = g.field_notes.select(F.col("id").alias("note_id"), F.col("booking_id").alias("_nb"),
                             F.col("mechanic_id").alias("note_mechanic_id"), "note",
                             F.col("date").alias("note_date"), "parts_needed",
                             F.col("status").alias("note_status"))
    b = g.bookings.select(F.col("id").alias("booking_id"), "service_id", "customer_id", "vehicle_id")
    return (n.join(b, F.col("_nb") == F.col("booking_id"))
            .join(_services(g), F.col("service_id") == F.col("_sid"))
            .join(_owners(g), F.col("customer_id") == F.col("_cid"))
            .join(_vehicles(g), F.col("vehicle_id") == F.col("_vid"))
            .join(_mechanic_labels(g), F.col("note_mechanic_id") == F.col("_mid"), "left")
            .select("note_id", "booking_id", "note_mechanic_id", "mechanic_name", "note", "note_date",
                    "parts_needed", "note_status", "service_name", "customer_id", "customer_name",
                    "make", "model", "license_plate"))


def vehicles_with_owner(g: Garage) -> DataFrame:
    """Vehicles INNER-joined to owner customer and user (unowned drop out)."""
    return (g.vehicles.join(_owners(g), F.col("customer_id") == F.col("_cid"))
            .select("id", "customer_id", "make", "model", "year", "license_plate", "vin",
                    F.col("customer_name").alias("owner_name"),
                    F.col("customer_email").alias("owner_email")))


def tasks_on_dates(g: Garage, start: Date, end: Date) -> DataFrame:
    """Tasks whose booking falls in [start, end] (``booking_id IN (SELECT ...)``)."""
    days = g.bookings.where(F.col("booking_date").between(_d(start), _d(end))).select(
        F.col("id").alias("booking_id"))
    return g.mechanic_tasks.join(days, "booking_id", "left_semi")


def completed_without_testimonial(g: Garage) -> DataFrame:
    """Completed bookings with no testimonial for the same service and customer."""
    done = g.bookings.where(F.col("status") == "completed")
    reviewed = g.testimonials.select("service_id", "customer_id")
    return (done.join(reviewed, ["service_id", "customer_id"], "left_anti")
            .join(_services(g), F.col("service_id") == F.col("_sid"))
            .select("id", "booking_date", "customer_id", "service_id", "service_name", "mechanic_id"))


def resolve_task_or_booking(g: Garage, refs: DataFrame, ref_col: str = "ref") -> DataFrame:
    """A reference may name a task id or a booking id.

    Instead of the reference's ``mt.id = $1 OR b.id = $1`` (a join on OR that
    cannot hash-partition), two equi-joins are unioned: task-id matches, then
    booking-id matches not already resolved through a task.
    """
    r = refs.select(F.col(ref_col).cast("string").alias("ref")).distinct()
    tasks = g.mechanic_tasks.select(F.col("id").alias("task_id"), "booking_id",
                                    F.col("status").alias("task_status"), "mechanic_id")
    by_task = r.join(tasks, F.col("ref") == F.col("task_id").cast("string"))
    by_booking = (r.join(by_task.select("ref"), "ref", "left_anti")
                  .join(g.bookings.select(F.col("id").alias("booking_id"), "mechanic_id"),
                        F.col("ref") == F.col("booking_id"))
                  .join(tasks.select("task_id", F.col("booking_id").alias("_tb"), "task_status",
                                     F.col("mechanic_id").alias("_tm")),
                        (F.col("booking_id") == F.col("_tb")) & (F.col("mechanic_id") == F.col("_tm")),
                        "left")
                  .select("ref", "task_id", "booking_id", "task_status", "mechanic_id"))
    return (by_task.select("ref", "task_id", "booking_id", "task_status", "mechanic_id")
            .withColumn("matched_by", F.lit("task"))
            .unionByName(by_booking.withColumn("matched_by", F.lit("booking"))))


# --- J14..J22 ----------------------------------------------------------------

def related_bookings(g: Garage) -> DataFrame:
    """Bookings made together (same customer, date, time and vehicle).

    Bookings are counted per group and service (partial, map-side), only these counts
    meet the services, and their sums per group are joined back: a hot
    group is never gathered, and services are joined once.  Only bookings
    whose group has more than one member with a service are returned.
    """
    keys = ["customer_id", "booking_date", "start_min", "vehicle_id"]
    per = (g.bookings.groupBy(*keys, "service_id").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
           .join(_services(g).select("_sid", "service_price"), F.col("service_id") == F.col("_sid")))
    whole = Window.partitionBy(*keys)  # a row per service
    per = (per.withColumn("related_count", F.sum("_n").over(whole))
           .withColumn("total_services_price", F.sum(F.col("service_price") * F.col("_n")).over(whole))
           .withColumn("first_booking_id", F.min("_first").over(whole)).where(F.col("related_count") > 1)
           .select(*keys, "service_id", "related_count", "total_services_price", "first_booking_id"))
    return g.bookings.join(per, [*keys, "service_id"]).select("id", *keys, "related_count", "total_services_price", "first_booking_id")


def related_documents(g: Garage) -> DataFrame:
    """One document per group of bookings made together: (first_booking_id, part, siblings[]).

    Siblings are (id, service_id, service_name, service_price) in id order, in
    pages as every nested list; ``related_bookings`` names each booking's group.
    """
    from wrenchflow.operators.nested import nest_children
    of = related_bookings(g).select(F.col("id").alias("_id"), "first_booking_id")
    members = (g.bookings.select("id", "service_id").join(of, F.col("id") == F.col("_id"))
               .join(_services(g).select("_sid", "service_name", "service_price"), F.col("service_id") == F.col("_sid")))
    return nest_children(members, "first_booking_id", ["id", "service_id", "service_name", "service_price"], "siblings")


def payments_joined(g: Garage) -> DataFrame:
    """Payment rows joined to booking, service, customer, vehicle and mechanic."""
    p = g.payments.select(F.col("id").alias("payment_id"), F.col("booking_id").alias("_pb"),
                          "payment_method", "is_down_payment", "down_payment_percent",
                          "down_payment_amount", "payment_status", "admin_notes", "payment_date", "created_at", "updated_at")
    b = g.bookings.select(F.col("id").alias("booking_id"), "booking_date", "start_min", "status",
                          "service_id", "customer_id", "vehicle_id", "mechanic_id", "total_price")
    return (p.join(b, F.col("_pb") == F.col("booking_id"))
            .join(_services(g), F.col("service_id") == F.col("_sid"))
            .join(_owners(g), F.col("customer_id") == F.col("_cid"))
            .join(_vehicles(g), F.col("vehicle_id") == F.col("_vid"))
            .join(_mechanic_labels(g), F.col("mechanic_id") == F.col("_mid"), "left")
            .select("payment_id", "booking_id", "payment_method", "is_down_payment", "down_payment_percent",
                    "down_payment_amount", "payment_status", "admin_notes", "payment_date", "booking_date",
                    "status", "total_price", "service_id", "service_name", "service_price", "customer_name", "make",
                    "model", "license_plate", "mechanic_name", "customer_id", "vehicle_id", "year", "mechanic_id", "created_at",
                    "updated_at"))


def payments_history(g: Garage, start: Date | None = None, end: Date | None = None,
                     term: str | None = None, status: str | None = None) -> DataFrame:
    """Settled (non-pending) payments, optional date range and search."""
    from wrenchflow.functions.predicates import contains_ci, fold
    df = payments_joined(g)
    return df.where(fold([
        F.col("payment_status") != "pending",
        F.col("payment_status") == status if status and status != "all" else None,
        F.col("payment_date").cast("date").between(_d(start), _d(end)) if start and end else None,
        contains_ci(["booking_id", "customer_name", "license_plate"], term) if term else None,
    ]))


def payments_pending(g: Garage) -> DataFrame:
    """Pending payments with the same joins."""
    return payments_joined(g).where(F.col("payment_status") == "pending")


def testimonial_wall(g: Garage, scope: str = "approved", service_id: int | None = None,
                     mechanic_id: int | None = None, customer_id: int | None = None) -> DataFrame:
    """Testimonials with customer, service and (LEFT) mechanic names.

    Scopes: approved, featured (approved and featured), pending, all,
    service, mechanic (approved ones of that service/mechanic), own.
    """
    t = g.testimonials
    scope_pred = {
        "approved": F.col("approved"),
        "featured": F.col("approved") & F.col("featured"),
        "pending": ~F.col("approved"),
        "all": F.lit(True),
        "service": F.col("approved") & (F.col("service_id") == F.lit(service_id)),
        "mechanic": F.col("approved") & (F.col("mechanic_id") == F.lit(mechanic_id)),
        "own": F.col("customer_id") == F.lit(customer_id),
    }
    if scope not in scope_pred:
        raise ValueError(f"unknown scope {scope!r}")
    return (t.where(scope_pred[scope])
            .join(_owners(g), F.col("customer_id") == F.col("_cid"))
            .join(_services(g), F.col("service_id") == F.col("_sid"))
            .join(_mechanic_labels(g), F.col("mechanic_id") == F.col("_mid"), "left")
            .select("id", "customer_id", "service_id", "mechanic_id", "rating", "comment", "date",
                    "approved", "featured", "customer_name", "service_name", "mechanic_name"))


def orphan_bookings(g: Garage, vehicles: DataFrame | None = None) -> DataFrame:
    """Bookings whose vehicle row is missing (anti join), with names."""
    v = (vehicles if vehicles is not None else g.vehicles).select(F.col("id").alias("vehicle_id"))
    return (g.bookings.drop("customer_name").join(v, "vehicle_id", "left_anti")
            .join(_owners(g), F.col("customer_id") == F.col("_cid"), "left")
            .join(_services(g), F.col("service_id") == F.col("_sid"), "left")
            .select("id", "vehicle_id", "customer_id", "customer_name", "service_name", "booking_date"))


def unowned_vehicles(g: Garage) -> DataFrame:
    """Vehicles with no owner."""
    return g.vehicles.where(F.col("customer_id").isNull())


def user_profile(g: Garage) -> DataFrame:
    """Users with role-specific mechanic or customer attributes (two LEFT joins)."""
    m = g.mechanics.select(F.col("user_id").alias("_mu"), F.col("id").alias("mechanic_id"),
                           "specialization", "experience")
    c = g.customers.select(F.col("user_id").alias("_cu"), F.col("id").alias("customer_id"),
                           "address")
    return (g.users.join(m, F.col("id") == F.col("_mu"), "left")
            .join(c, F.col("id") == F.col("_cu"), "left")
            .select("id", "name", "email", "role", "status",
                    F.when(F.col("role") == "mechanic", F.col("mechanic_id")).alias("mechanic_id"),
                    F.when(F.col("role") == "mechanic", F.col("specialization")).alias("specialization"),
                    F.when(F.col("role") == "mechanic", F.col("experience")).alias("experience"),
                    F.when(F.col("role") == "customer", F.col("customer_id")).alias("customer_id"),
                    F.when(F.col("role") == "customer", F.col("address")).alias("address")))


def referential_check(child: DataFrame, fk: str, parent: DataFrame, parent_key: str = "id",
                      flag: str = "parent_exists") -> DataFrame:
    """Flag each child row whose foreign key has (no) parent row.

    A LEFT join against the distinct parent keys; NULL keys count as
    missing.  ``where(~flag)`` gives the rejects.
    """
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct().withColumn("_hit", F.lit(True))
    return (child.join(keys, F.col(fk) == F.col("_pk"), "left")
            .withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False)))
            .drop("_pk", "_hit"))


def mechanic_daily_tasks(g: Garage, date: Date | None = None) -> DataFrame:
    """J6 daily form + E14: assigned bookings (of one date, or all) with task columns
    and the booking's field notes joined as ``'a, b, c'`` (sorted; the reference's
    ``string_agg`` order is unspecified).

    Notes are nested with ``nest_children``: a booking appears once per page of
    its ordered notes (``part``), at every size.
    """
    from wrenchflow.operators.nested import nest_children
    notes = g.field_notes
    if date is not None:  # only the chosen bookings' notes are nested
        day = g.bookings.where(F.col("mechanic_id").isNotNull() & (F.col("booking_date") == _d(date)))
        notes = notes.join(day.select(F.col("id").alias("_b")), F.col("booking_id") == F.col("_b"), "left_semi")
    notes = nest_children(notes, "booking_id", ["note", "id"], "_notes")
    txt = notes.select(F.col("booking_id").alias("_nb"), "part",
                       F.array_join(F.transform("_notes", lambda n: n["note"]), ", ").alias("field_notes"))
    return (_assigned(g, start=date, end=date, notes=txt)
            .withColumn("part", F.coalesce(F.col("part"), F.lit(0)))
            .withColumn("field_notes", F.coalesce(F.col("field_notes"), F.lit(""))))
