"""Dashboard, report and insight aggregations.

Patterns used throughout:

* Bookings are aggregated *before* they meet a dimension (pre-aggregation):
  the partial aggregate runs map-side, so a key holding a third of all rows
  shuffles one partial row per task, and the join that follows is between
  two small-per-key sides.
* ``COUNT(CASE WHEN ...)`` is ``count_if``; averages are ``sum / count``
  with an exact integer or decimal sum.
* One-row reports are assembled by ``combine_rows`` (union + one global
  aggregate) -- no cross joins.
* Top-k (``ORDER BY ... LIMIT k``) always carries a key tie-breaker (T7) and
  plans as ``TakeOrderedAndProject`` (no global sort).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.functions import dates as D
from wrenchflow.functions.exprs import hours_between, round_half_up, weekday0
from wrenchflow.functions.predicates import Date, _d, last_n_days, period_to_date
from wrenchflow.model import BOOKING_STATUSES, REVENUE_PERIODS
from wrenchflow.operators.enrich import bookings_enriched, customer_names, joinable, mechanic_names
from wrenchflow.sources.tables import Garage


def _status_is(s: str) -> Column:
    return F.col("status") == s


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def status_counts(prefix: str = "", suffix: str = "") -> list[Column]:
    """count_if per booking status, as ``{prefix}{status}{suffix}`` columns."""
    return [_count_if(_status_is(s)).alias(f"{prefix}{s.replace('-', '_')}{suffix}")
            for s in BOOKING_STATUSES]


def combine_rows(frames: list[DataFrame]) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row.

    unionByName (missing columns NULL) then a single global aggregate taking
    the one non-NULL value per column; replaces a chain of cross joins.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def status_rank(col: str = "status") -> Column:
    """L4: workflow order pending < confirmed < in-progress < completed < cancelled."""
    expr = F.when(F.col(col) == BOOKING_STATUSES[0], 1)
    for i, s in enumerate(BOOKING_STATUSES[1:], start=2):
        expr = expr.when(F.col(col) == s, i)
    return expr


def _in_range(start: Date, end: Date, col: str = "booking_date") -> Column:
    return F.col(col).between(_d(start), _d(end))


def _svc_names(g: Garage) -> DataFrame:
    return g.services.select(F.col("id").alias("_sid"), F.col("name").alias("service_name"),
                             "category", "price")


# --- A1 -----------------------------------------------------------------------

def dashboard_stats(g: Garage, as_of: Date) -> DataFrame:
    """A1 (contract view ``dashboard_stats``), one row.

    Our definition: bookings per status and their sum; customers; mechanics
    whose user is active; services; vehicles; approved / pending
    testimonials; unread incoming messages; revenue of completed bookings
    from the start of ``as_of``'s month; average approved testimonial rating
    (2 dp).
    """
    b = g.bookings.agg(*status_counts(suffix="_bookings"), F.count("*").alias("total_bookings"),
                       F.sum(F.when(_status_is("completed") & period_to_date("booking_date", "month", as_of),
                                    F.col("total_price"))).alias("monthly_revenue"))
    active_mech = (mechanic_names(g).where(F.col("user_status") == "active")
                   .agg(F.count("*").alias("active_mechanics")))
    t = g.testimonials.agg(
        _count_if(F.col("approved")).alias("approved_testimonials"),
        _count_if(~F.col("approved")).alias("pending_testimonials"),
        F.sum(F.when(F.col("approved"), F.col("rating"))).alias("_rsum"),
        F.count(F.when(F.col("approved"), F.col("rating"))).alias("_rcnt"))
    frames = [
        b, active_mech, t,
        g.customers.agg(F.count("*").alias("total_customers")),
        g.services.agg(F.count("*").alias("total_services")),
        g.vehicles.agg(F.count("*").alias("total_vehicles")),
        g.customer_messages.agg(_count_if((F.col("type") == "incoming") & ~F.col("is_read"))
                                .alias("unread_messages")),
    ]
    row = combine_rows(frames)
    return (row.withColumn("monthly_revenue", F.coalesce(F.col("monthly_revenue"), F.lit(0).cast("decimal(22,2)")))
            .withColumn("average_rating", F.coalesce(round_half_up(F.col("_rsum") / F.col("_rcnt"), 2), F.lit(0.0)))
            .drop("_rsum", "_rcnt"))


# --- A2..A4 calendar buckets --------------------------------------------------

def _bucket_counts() -> list[Column]:
    return [F.count("*").alias("bookings"), _count_if(_status_is("completed")).alias("completed"),
            _count_if(_status_is("cancelled")).alias("cancelled")]


def bookings_by_weekday(g: Garage, as_of: Date, days: int = 7) -> DataFrame:
    """A2: last ``days`` days (no upper bound) per weekday name, Sunday = 0."""
    return (g.bookings.where(last_n_days("booking_date", days, as_of))
            .groupBy(F.date_format("booking_date", "EEE").alias("name"), weekday0("booking_date").alias("dow"))
            .agg(*_bucket_counts()).orderBy("dow"))


def bookings_by_week(g: Garage, as_of: Date) -> DataFrame:
    """A3: month to date per ISO week, labelled ``Week n`` (T4 formula kept)."""
    first = F.weekofyear(F.trunc(_d(as_of), "month"))
    return (g.bookings.where(period_to_date("booking_date", "month", as_of))
            .groupBy(F.weekofyear("booking_date").alias("week"))
            .agg(*_bucket_counts())
            .withColumn("name", F.concat(F.lit("Week "), (F.col("week") - first + 1).cast("string")))
            .orderBy("week"))


def bookings_by_month(g: Garage, as_of: Date) -> DataFrame:
    """A4: year to date per month name."""
    return (g.bookings.where(period_to_date("booking_date", "year", as_of))
            .groupBy(F.date_format("booking_date", "MMM").alias("name"), F.month("booking_date").alias("month"))
            .agg(*_bucket_counts()).orderBy("month"))


# --- A5..A14 dashboard lists ------------------------------------------------------

def _per_service_counts(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy(F.col("service_id").alias("_bsid")).agg(F.count("id").alias("_n"))


def service_stats(g: Garage, k: int = 5) -> DataFrame:
    """A5: bookings per service *name* (zero included), top ``k``."""
    counts = _per_service_counts(g.bookings)
    per_name = (g.services.join(counts, F.col("id") == F.col("_bsid"), "left")
                .groupBy("name").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("value")))
    return per_name.orderBy(F.col("value").desc(), F.col("name").asc_nulls_last()).limit(k)


def _mechanic_booking_stats(bookings: DataFrame) -> DataFrame:
    return bookings.where(F.col("mechanic_id").isNotNull()).groupBy(F.col("mechanic_id").alias("_bm")).agg(
        _count_if(_status_is("completed")).alias("_done"), F.sum("rating").alias("_rsum"),
        F.count("rating").alias("_rcnt"), F.count("id").alias("_jobs"))


def mechanic_performance_top(g: Garage, k: int = 5) -> DataFrame:
    """Completed jobs and average booking rating (0 if none) per mechanic user, top ``k``."""
    stats = _mechanic_booking_stats(g.bookings)
    u = g.users.where(F.col("role") == "mechanic").select(F.col("id").alias("uid"), "name")
    per_user = (u.join(g.mechanics.select(F.col("id").alias("mid"), "user_id"), F.col("uid") == F.col("user_id"))
                .join(stats, F.col("mid") == F.col("_bm"), "left")
                .groupBy("uid", "name")
                .agg(F.coalesce(F.sum("_done"), F.lit(0)).alias("jobs"),
                     F.sum("_rsum").alias("_rsum"), F.sum("_rcnt").alias("_rcnt")))
    return (per_user.withColumn("rating", F.coalesce(round_half_up(F.col("_rsum") / F.col("_rcnt"), 2), F.lit(0.0)))
            .orderBy(F.col("jobs").desc(), F.col("uid").asc()).limit(k)
            .select("name", "jobs", "rating"))


def bookings_by_status(g: Garage, as_of: Date, days: int = 30) -> DataFrame:
    """Last ``days`` days per status in workflow order (L4)."""
    return (g.bookings.where(last_n_days("booking_date", days, as_of))
            .groupBy("status").agg(F.count("*").alias("count"))
            .orderBy(status_rank().asc_nulls_last(), "status"))


def mechanic_workload(g: Garage, as_of: Date, days: int = 30) -> DataFrame:
    """Per active mechanic, task counts of the last ``days`` days.

    The date test sits in the LEFT JOIN's ON in the reference, so mechanics
    without recent work keep a row of zeros; here the bookings are filtered
    and pre-aggregated first, then LEFT-joined.
    """
    recent = g.bookings.where(last_n_days("booking_date", days, as_of) & F.col("mechanic_id").isNotNull())
    stats = recent.groupBy(F.col("mechanic_id").alias("_bm")).agg(
        _count_if(_status_is("pending")).alias("pending_tasks"),
        _count_if(_status_is("confirmed")).alias("confirmed_tasks"),
        _count_if(_status_is("in-progress")).alias("in_progress_tasks"),
        _count_if(_status_is("completed")).alias("completed_tasks_30d"),
        F.count("id").alias("total_tasks"))
    m = mechanic_names(g).where(F.col("user_status") == "active")
    cols = ["pending_tasks", "confirmed_tasks", "in_progress_tasks", "completed_tasks_30d", "total_tasks"]
    return (m.join(stats, F.col("id") == F.col("_bm"), "left")
            .select(F.col("id").alias("mechanic_id"), F.col("name").alias("mechanic_name"),
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])
            .orderBy(F.col("total_tasks").desc(), "mechanic_id"))


def service_popularity(g: Garage) -> DataFrame:
    """A9 (contract view ``service_popularity``).

    Our definition: every service with its total and completed bookings,
    the average rating of its rated bookings (2 dp, NULL if none) and price;
    by total bookings descending.
    """
    stats = g.bookings.groupBy(F.col("service_id").alias("_bsid")).agg(
        F.count("id").alias("total_bookings"), _count_if(_status_is("completed")).alias("completed_bookings"),
        F.sum("rating").alias("_rsum"), F.count("rating").alias("_rcnt"))
    return (g.services.join(stats, F.col("id") == F.col("_bsid"), "left")
            .select("id", "name", "category",
                    F.coalesce("total_bookings", F.lit(0)).alias("total_bookings"),
                    F.coalesce("completed_bookings", F.lit(0)).alias("completed_bookings"),
                    round_half_up(F.col("_rsum") / F.col("_rcnt"), 2).alias("average_rating"), "price")
            .orderBy(F.col("total_bookings").desc(), "id"))


def bookings_by_service(g: Garage, as_of: Date, period_days: int = 30, faithful: bool = False) -> DataFrame:
    """A10: per service, non-cancelled bookings of the period and revenue.

    The reference sums ``s.price`` across a LEFT JOIN, which credits a
    service with no bookings with one price (T19).  ``faithful=True``
    reproduces that; the default counts matched bookings only.
    """
    live = g.bookings.where(last_n_days("booking_date", period_days, as_of) & (F.col("status") != "cancelled"))
    counts = _per_service_counts(live)
    n = F.coalesce(F.col("_n"), F.lit(0))
    mult = F.greatest(n, F.lit(1)) if faithful else n
    return (g.services.join(counts, F.col("id") == F.col("_bsid"), "left")
            .select(F.col("id").alias("service_id"), F.col("name").alias("service_name"), "category",
                    n.alias("booking_count"),
                    F.when(mult > 0, F.col("price") * mult).alias("total_revenue"))
            .orderBy(F.col("booking_count").desc(), "service_id"))


def customer_spend(g: Garage) -> DataFrame:
    """A11 (contract view ``customer_activity``).

    Our definition: per customer with bookings, the number of bookings and
    the total price of its completed bookings (0 if none).
    """
    return g.bookings.groupBy(F.col("customer_id").alias("id")).agg(
        F.count("*").alias("total_bookings"),
        F.coalesce(F.sum(F.when(_status_is("completed"), F.col("total_price"))),
                   F.lit(0).cast("decimal(22,2)")).alias("total_spent"))


def customer_activity(g: Garage) -> DataFrame:
    """A11 joined to customer and user e-mail, by total spent."""
    c = customer_names(g).select(F.col("id").alias("_cid"), "name", "email")
    return (customer_spend(g).join(c, F.col("id") == F.col("_cid"))
            .select("id", "name", "email", "total_bookings", "total_spent")
            .orderBy(F.col("total_spent").desc(), "id"))


def revenue_by_period(g: Garage, period_type: str = "monthly", start: Date | None = None,
                      end: Date | None = None, as_of: Date | None = None) -> DataFrame:
    """A12 (contract routine ``calculate_revenue``).

    Our definition: bookings dated in [start, end] (default: 12 months up to
    ``as_of``) bucketed by day / ISO week start / month / year; revenue and
    count of completed bookings per bucket.
    """
    if period_type not in REVENUE_PERIODS:
        raise ValueError(f"period_type must be one of {REVENUE_PERIODS}")
    if start is None or end is None:
        start, end = D.default_revenue_window(as_of)
    d = F.col("booking_date")
    label = {
        "daily": F.date_format(d, "yyyy-MM-dd"),
        "weekly": F.date_format(F.date_trunc("week", d), "yyyy-MM-dd"),
        "monthly": F.date_format(d, "yyyy-MM"),
        "yearly": F.date_format(d, "yyyy"),
    }[period_type]
    done = _status_is("completed")
    return (g.bookings.where(_in_range(start, end)).groupBy(label.alias("period"))
            .agg(F.coalesce(F.sum(F.when(done, F.col("total_price"))), F.lit(0).cast("decimal(22,2)"))
                 .alias("total_revenue"), _count_if(done).alias("completed_bookings"))
            .orderBy("period"))


def bookings_by_hour(g: Garage, as_of: Date, period_days: int = 90) -> DataFrame:
    """Non-cancelled bookings of the period per start hour."""
    return (g.bookings.where(last_n_days("booking_date", period_days, as_of) & (F.col("status") != "cancelled"))
            .groupBy(F.floor(F.col("start_min") / 60).alias("hour"))
            .agg(F.count("*").alias("booking_count")).orderBy("hour"))


def pending_testimonials_count(g: Garage) -> DataFrame:
    """Number of unapproved testimonials."""
    return g.testimonials.agg(_count_if(~F.col("approved")).alias("pending_count"))


# --- A15..A18 reports -------------------------------------------------------------

def booking_report_summary(g: Garage, start: Date, end: Date) -> DataFrame:
    """Totals and mean service hours (1 dp, 0 if none) of the range."""
    secs = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))
    return (g.bookings.where(_in_range(start, end))
            .agg(F.count("*").alias("total_bookings"),
                 _count_if(_status_is("completed")).alias("completed_bookings"),
                 _count_if(_status_is("cancelled")).alias("cancelled_bookings"),
                 F.avg(secs).alias("_avg_secs"))
            .withColumn("average_service_time",
                        F.coalesce(round_half_up(F.col("_avg_secs") / 3600.0, 1), F.lit(0.0)))
            .drop("_avg_secs"))


def booking_report_detail(g: Garage, start: Date, end: Date) -> DataFrame:
    """Booking rows of the range with names; '-' for no mechanic; hours 1 dp."""
    b = g.bookings.where(_in_range(start, end))
    e = bookings_enriched(g, b)
    dur = F.when(F.col("completed_at").isNotNull() & F.col("started_at").isNotNull(),
                 round_half_up(hours_between("started_at", "completed_at"), 1))
    return e.select("id", F.col("booking_date").alias("date"), "customer_name", "service_name",
                    F.coalesce(F.col("mechanic_name"), F.lit("-")).alias("mechanic_name"), "status",
                    dur.alias("duration"))


def feedback_report_summary(g: Garage, start: Date, end: Date) -> DataFrame:
    """Testimonial count, average rating (2 dp) and % rated 4 or 5 (0 if none)."""
    t = g.testimonials.where(_in_range(start, end, "date"))
    return t.agg(F.count("*").alias("total_testimonials"), F.sum("rating").alias("_s"),
                 F.count("rating").alias("_c"), _count_if(F.col("rating") >= 4).alias("_hi")).select(
        "total_testimonials",
        F.coalesce(round_half_up(F.col("_s") / F.col("_c"), 2), F.lit(0.0)).alias("average_rating"),
        F.coalesce(round_half_up(F.try_divide(F.col("_hi") * 100.0, F.col("total_testimonials")), 0),
                   F.lit(0)).cast("long").alias("satisfaction_rate"))


def feedback_report_detail(g: Garage, start: Date, end: Date) -> DataFrame:
    """Testimonial rows of the range with customer and service names."""
    t = g.testimonials.where(_in_range(start, end, "date"))
    c = customer_names(g).select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"))
    return (t.join(c, F.col("customer_id") == F.col("_cid")).join(_svc_names(g), F.col("service_id") == F.col("_sid"))
            .select("id", "date", "customer_name", "service_name", "rating", "comment"))


# --- A19..A24 generated reports and insights --------------------------------------

def generate_report(g: Garage, report_type: str, report_date: Date) -> DataFrame:
    """One report row for the derived range (E7), ready for ``append_report``."""
    start, end = D.report_range(report_type, report_date)
    done = _status_is("completed")
    # the range is scanned once: counts per service and per mechanic, which then meet the names
    per = g.bookings.where(_in_range(start, end)).groupingSets(
        [["service_id"], ["mechanic_id"]], "service_id", "mechanic_id").agg(
        F.grouping("mechanic_id").alias("_of_service"), F.count("*").alias("_n"), _count_if(done).alias("_done"),
        _count_if(_status_is("cancelled")).alias("_cancelled"), F.sum(F.when(done, F.col("rating"))).alias("_rating"),
        F.count(F.when(done, F.col("rating"))).alias("_rated"))
    m = mechanic_names(g).select(F.col("id").alias("_mid"), F.col("name").alias("_mname"))
    named = (per.join(_svc_names(g).withColumn("_known", F.lit(1)), F.col("service_id") == F.col("_sid"), "left")
             .join(m.withColumn("_works", F.lit(1)), F.col("mechanic_id") == F.col("_mid"), "left"))
    of_service = (F.col("_of_service") == 1) & F.col("_known").isNotNull()
    of_mechanic = (F.col("_of_service") == 0) & F.col("_works").isNotNull() & (F.col("_done") > 0)
    names = named.where(of_service | of_mechanic).groupBy("_of_service", F.when(of_service, F.col("service_name"))
                                                          .otherwise(F.col("_mname")).alias("_name")).agg(
        *[F.sum(c).alias(c) for c in ("_n", "_done", "_cancelled", "_rating", "_rated")],
        F.sum(F.col("price") * F.col("_done")).alias("_revenue"))
    svc, mech = F.col("_of_service") == 1, F.col("_of_service") == 0
    best = lambda which, n: F.min(F.when(which, F.struct((-F.col(n)).alias("n"), F.col("_name").isNull().alias("no"), "_name")))
    row = names.agg(F.coalesce(F.sum(F.when(svc, F.col("_n"))), F.lit(0)).alias("total_bookings"),
                    F.coalesce(F.sum(F.when(svc, F.col("_done"))), F.lit(0)).alias("completed_bookings"),
                    F.coalesce(F.sum(F.when(svc, F.col("_cancelled"))), F.lit(0)).alias("cancelled_bookings"),
                    F.coalesce(F.sum(F.when(svc, F.col("_revenue"))), F.lit(0)).cast("decimal(22,2)").alias("total_revenue"),
                    F.sum(F.when(svc, F.col("_rating"))).alias("_rs"), F.sum(F.when(svc, F.col("_rated"))).alias("_rc"),
                    best(svc, "_n")["_name"].alias("top_service"), best(mech, "_done")["_name"].alias("top_mechanic"))
    return row.select(
        F.lit(report_type).alias("report_type"), F.lit(str(D.as_date(report_date))).alias("report_date"),
        F.lit(str(start)).alias("start_date"), F.lit(str(end)).alias("end_date"),
        "total_bookings", "completed_bookings", "cancelled_bookings", "total_revenue",
        round_half_up(F.col("_rs") / F.col("_rc"), 2).alias("average_rating"), "top_service", "top_mechanic")


def period_growth(g: Garage, range_name: str, as_of: Date) -> DataFrame:
    """Bookings now vs the previous period and growth % (Math.round, 0 if no base)."""
    s, e, ps, pe = D.insight_range(range_name, as_of)
    both = g.bookings.where(_in_range(ps, pe) | _in_range(s, e)).where(  # the outer bounds reach the scan
        (F.col("booking_date") >= _d(min(ps, s))) & (F.col("booking_date") <= _d(max(pe, e))))
    row = both.agg(_count_if(_in_range(s, e)).alias("current_bookings"),
                   _count_if(_in_range(ps, pe)).alias("previous_bookings"))
    growth = F.when(F.col("previous_bookings") > 0,
                    round_half_up((F.col("current_bookings") - F.col("previous_bookings")) * 100.0
                                  / F.col("previous_bookings"), 0)).otherwise(F.lit(0))
    return row.withColumn("growth_rate", growth.cast("long"))


def _with_default(top: DataFrame, default: dict) -> DataFrame:
    """Top-1 row, or the default row when the range is empty."""
    spark = top.sparkSession
    fallback = spark.range(1).select(*[F.lit(v).cast(top.schema[k].dataType).alias(k) for k, v in default.items()])
    return (top.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
            .orderBy("_p").limit(1).drop("_p"))


def insight_top_service(g: Garage, range_name: str, as_of: Date) -> DataFrame:
    """Most booked service name of the period with revenue; 'No data' if none."""
    s, e, _, _ = D.insight_range(range_name, as_of)
    b = (g.bookings.where(_in_range(s, e)).groupBy("service_id")  # one row per service meets the names
         .agg(F.count("*").alias("_n"), F.sum("total_price").alias("_r"))
         .join(_svc_names(g), F.col("service_id") == F.col("_sid")))
    top = (b.groupBy(F.col("service_name").alias("name"))
           .agg(F.sum("_n").alias("bookings"), F.sum("_r").cast("decimal(22,2)").alias("revenue"))
           .orderBy(F.col("bookings").desc(), F.col("name").asc_nulls_last()).limit(1))
    return _with_default(top, {"name": "No data", "bookings": 0, "revenue": 0})


def insight_top_mechanic(g: Garage, range_name: str, as_of: Date) -> DataFrame:
    """Mechanic with most completed jobs of the period, rating 1 dp; 'No data' if none."""
    s, e, _, _ = D.insight_range(range_name, as_of)
    m = mechanic_names(g).select(F.col("id").alias("_mid"), F.col("name").alias("name"))
    b = (g.bookings.where(_in_range(s, e) & _status_is("completed")).groupBy("mechanic_id")
         .agg(F.count("*").alias("_n"), F.sum("rating").alias("_rs"), F.count("rating").alias("_rc"))
         .join(m, F.col("mechanic_id") == F.col("_mid")))
    top = (b.groupBy("name").agg(F.sum("_n").alias("completed_jobs"), F.sum("_rs").alias("_s"), F.sum("_rc").alias("_c"))
           .orderBy(F.col("completed_jobs").desc(), F.col("name").asc_nulls_last()).limit(1)
           .select("name", "completed_jobs", round_half_up(F.col("_s") / F.col("_c"), 1).alias("rating")))
    return _with_default(top, {"name": "No data", "completed_jobs": 0, "rating": 0.0})


def potential_revenue(g: Garage, range_name: str, as_of: Date) -> DataFrame:
    """``round(avg(price) * distinct booking days * 10)``, 0 on empty input."""
    s, e, _, _ = D.insight_range(range_name, as_of)
    b = (g.bookings.where(_in_range(s, e)).groupBy("service_id", "booking_date").agg(F.count("*").alias("_n"))
         .join(_svc_names(g), F.col("service_id") == F.col("_sid")))
    agg = b.agg(F.sum(F.col("price") * F.col("_n")).cast("double").alias("_s"),
                F.sum(F.when(F.col("price").isNotNull(), F.col("_n"))).alias("_c"),
                F.countDistinct("booking_date").alias("_days"))
    pot = F.col("_s") * F.col("_days") * 10 / F.col("_c")
    return agg.select(F.coalesce(round_half_up(pot, 0), F.lit(0)).cast("long").alias("potential"))


def insight_top_services(g: Garage, range_name: str, as_of: Date, k: int = 5) -> DataFrame:
    """Top ``k`` service names of the period with revenue / 100000."""
    s, e, _, _ = D.insight_range(range_name, as_of)
    b = (g.bookings.where(_in_range(s, e)).groupBy("service_id")
         .agg(F.count("*").alias("_n"), F.sum("total_price").alias("_r"))
         .join(_svc_names(g), F.col("service_id") == F.col("_sid")))
    return (b.groupBy(F.col("service_name").alias("name"))
            .agg(F.sum("_n").alias("bookings"), (F.sum("_r").cast("double") / 100000).alias("revenue"))
            .orderBy(F.col("bookings").desc(), F.col("name").asc_nulls_last()).limit(k))


# --- A25..A35 -------------------------------------------------------------------------

def report_by_service(g: Garage, start: Date, end: Date) -> DataFrame:
    """Per service name, counts by outcome and revenue."""
    b = g.bookings.where(_in_range(start, end))
    per_sid = b.groupBy(F.col("service_id").alias("_bsid")).agg(
        F.count("*").alias("_n"), _count_if(_status_is("completed")).alias("_d"),
        _count_if(_status_is("cancelled")).alias("_x"), F.sum("total_price").alias("_r"))
    return (per_sid.join(_svc_names(g), F.col("_bsid") == F.col("_sid"))
            .groupBy("service_name").agg(
                F.sum("_n").alias("booking_count"), F.sum("_d").alias("completed_count"),
                F.sum("_x").alias("cancelled_count"),
                F.coalesce(F.sum("_r"), F.lit(0).cast("decimal(22,2)")).alias("total_revenue"))
            .orderBy(F.col("booking_count").desc(), "service_name"))


def report_by_mechanic(g: Garage, start: Date, end: Date) -> DataFrame:
    """Per mechanic name, bookings, completed and average completed rating (2 dp)."""
    done = _status_is("completed")
    per_mid = g.bookings.where(_in_range(start, end) & F.col("mechanic_id").isNotNull()).groupBy(
        F.col("mechanic_id").alias("_bm")).agg(
        F.count("*").alias("_n"), _count_if(done).alias("_d"),
        F.sum(F.when(done, F.col("rating"))).alias("_s"), F.count(F.when(done, F.col("rating"))).alias("_c"))
    m = mechanic_names(g).select(F.col("id").alias("_mid"), F.col("name").alias("mechanic_name"))
    return (per_mid.join(m, F.col("_bm") == F.col("_mid")).groupBy("mechanic_name")
            .agg(F.sum("_n").alias("booking_count"), F.sum("_d").alias("completed_count"),
                 F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
            .select("mechanic_name", "booking_count", "completed_count",
                    round_half_up(F.col("_s") / F.col("_c"), 2).alias("average_rating"))
            .orderBy(F.col("booking_count").desc(), "mechanic_name"))


def report_by_day(g: Garage, start: Date, end: Date) -> DataFrame:
    """Per day counts and revenue."""
    return (g.bookings.where(_in_range(start, end))
            .groupBy(F.date_format("booking_date", "yyyy-MM-dd").alias("booking_date"))
            .agg(F.count("*").alias("booking_count"), _count_if(_status_is("completed")).alias("completed_count"),
                 _count_if(_status_is("cancelled")).alias("cancelled_count"),
                 F.coalesce(F.sum("total_price"), F.lit(0).cast("decimal(22,2)")).alias("daily_revenue"))
            .orderBy("booking_date"))


def report_totals(g: Garage, start: Date, end: Date) -> DataFrame:
    """Whole-range totals, revenue and average completed rating (2 dp)."""
    done = _status_is("completed")
    return (g.bookings.where(_in_range(start, end))
            .agg(F.count("*").alias("total_bookings"), _count_if(done).alias("completed_bookings"),
                 _count_if(_status_is("cancelled")).alias("cancelled_bookings"),
                 F.coalesce(F.sum("total_price"), F.lit(0).cast("decimal(22,2)")).alias("total_revenue"),
                 F.sum(F.when(done, F.col("rating"))).alias("_s"), F.count(F.when(done, F.col("rating"))).alias("_c"))
            .withColumn("average_rating", round_half_up(F.col("_s") / F.col("_c"), 2)).drop("_s", "_c"))


def customer_booking_counter(g: Garage) -> DataFrame:
    """Recomputed bookings per customer vs the stored counter.

    Full outer join of the stored counters with pre-aggregated counts;
    returns the customers whose stored value differs (NULL-safe).
    """
    actual = g.bookings.groupBy(F.col("customer_id").alias("_bc")).agg(F.count("*").alias("actual_bookings"))
    stored = g.customers.select(F.col("id").alias("_cc"), F.col("total_bookings").alias("stored_bookings"))
    j = stored.join(actual, F.col("_cc") == F.col("_bc"), "full_outer")
    return (j.select(F.coalesce("_cc", "_bc").alias("customer_id"), "stored_bookings",
                     F.coalesce("actual_bookings", F.lit(0)).alias("actual_bookings"),
                     F.col("_cc").isNotNull().alias("customer_exists"))
            .where(~F.col("stored_bookings").eqNullSafe(F.col("actual_bookings"))))


def mechanic_day_week_stats(g: Garage, as_of: Date) -> DataFrame:
    """Per mechanic: tasks completed today, pending/in-progress today, tasks this Sun-Sat week, rating.

    The reference's three ``booking_id IN (SELECT ...)`` counts are folded
    into one join of tasks to booking dates and conditional counts.
    """
    ws, we = D.week_bounds_sunday(as_of)
    today = _d(as_of)
    # only this week's bookings count; today lies in this week
    days = g.bookings.where(_in_range(ws, we)).select(F.col("id").alias("_bid"), "booking_date")
    t = g.mechanic_tasks.join(days, F.col("booking_id") == F.col("_bid"))
    stats = t.groupBy(F.col("mechanic_id").alias("_tm")).agg(
        _count_if((F.col("status") == "completed") & (F.col("booking_date") == today)).alias("completed_today"),
        _count_if(F.col("status").isin("pending", "in-progress") & (F.col("booking_date") == today))
        .alias("pending_today"),
        _count_if(_in_range(ws, we)).alias("total_week"))
    cols = ["completed_today", "pending_today", "total_week"]
    return (g.mechanics.join(stats, F.col("id") == F.col("_tm"), "left")
            .select(F.col("id").alias("mechanic_id"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols],
                    F.coalesce(F.col("rating"), F.lit(0.0)).alias("rating")))


def mechanic_performance(g: Garage, as_of: Date) -> DataFrame:
    """A30 (contract view ``mechanic_performance``).

    Our definition: per mechanic, completed and total assigned bookings,
    completion rate % (2 dp, 0 without jobs), upcoming bookings (dated on or
    after ``as_of``, pending or confirmed), and stored rating.
    """
    upcoming = (F.col("booking_date") >= _d(as_of)) & F.col("status").isin("pending", "confirmed")
    stats = g.bookings.where(F.col("mechanic_id").isNotNull()).groupBy(F.col("mechanic_id").alias("_bm")).agg(
        _count_if(_status_is("completed")).alias("completed_jobs"), F.count("*").alias("total_jobs"),
        _count_if(upcoming).alias("upcoming_bookings"))
    m = mechanic_names(g)
    j = m.join(stats, F.col("id") == F.col("_bm"), "left")
    done, total = F.coalesce("completed_jobs", F.lit(0)), F.coalesce("total_jobs", F.lit(0))
    rate = F.when(total > 0, round_half_up(done * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return j.select("id", "name", "specialization", "experience", "rating", done.alias("completed_jobs"),
                    total.alias("total_jobs"), rate.alias("completion_rate"),
                    F.coalesce("upcoming_bookings", F.lit(0)).alias("upcoming_bookings"))


def user_booking_counts(g: Garage) -> DataFrame:
    """Every user with its bookings as a customer (0 for other roles)."""
    per_c = g.bookings.groupBy(F.col("customer_id").alias("_bc")).agg(F.count("*").alias("_n"))
    c = g.customers.select(F.col("id").alias("_cid"), F.col("user_id").alias("_cu"))
    counts = c.join(per_c, F.col("_cid") == F.col("_bc")).groupBy("_cu").agg(F.sum("_n").alias("_n"))
    return (g.users.join(counts, F.col("id") == F.col("_cu"), "left")
            .select("id", "name", "email", "role", "status",
                    F.when(F.col("role") == "customer", F.coalesce(F.col("_n"), F.lit(0))).otherwise(F.lit(0))
                    .alias("bookings")))


def page_totals(df: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """Pagination block as a one-row DataFrame (count runs on executors)."""
    n = F.count("*")
    return df.agg(n.alias("total_items")).select(
        "total_items", F.lit(page).alias("page"), F.lit(size).alias("page_size"),
        F.ceil(F.col("total_items") / size).alias("total_pages"),
        (F.lit(page) < F.ceil(F.col("total_items") / size)).alias("has_next"),
        (F.lit(page) > 1).alias("has_previous"))


def usage_counts(g: Garage, what: str = "service") -> DataFrame:
    """Bookings referencing each service / vehicle (checked before deletes)."""
    key, parent = {"service": ("service_id", g.services), "vehicle": ("vehicle_id", g.vehicles)}[what]
    counts = g.bookings.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return (parent.select("id").join(counts, F.col("id") == F.col("_k"), "left")
            .select(F.col("id").alias(key), F.coalesce("_n", F.lit(0)).alias("booking_count")))


def generate_booking_report(g: Garage, start: Date, end: Date) -> DataFrame:
    """A34 (contract routine ``generate_booking_report``).

    Our definition: one row joining A27's totals with A15's average service
    hours for the range.
    """
    return combine_rows([report_totals(g, start, end),
                         booking_report_summary(g, start, end).select("average_service_time")])


def upcoming_bookings(g: Garage, as_of: Date, k: int = 10) -> DataFrame:
    """A35 (contract view ``upcoming_bookings``).

    Our definition: the next ``k`` live (not cancelled / completed) bookings
    dated on or after ``as_of`` that J1 lists, enriched as J1, earliest first.
    """
    b = joinable(g, g.bookings, vehicle=True).where((F.col("booking_date") >= _d(as_of)) & ~F.col("status").isin("cancelled", "completed"))
    top = b.orderBy(F.col("booking_date").asc(), F.col("start_min").asc_nulls_last(), F.col("id").asc()).limit(k)
    return bookings_enriched(g, top).select("id", "booking_date", "start_min", "status", "customer_name",
                                            "service_name", "mechanic_name", "make", "model", "license_plate")
