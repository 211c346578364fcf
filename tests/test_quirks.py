"""Type and semantics rules T1-T23 on tiny inputs."""

import datetime as dt

from pyspark.sql import functions as F

from wrenchflow.functions.predicates import between_dates, last_n_days
from wrenchflow.operators import metrics as A
from wrenchflow.operators.enrich import bookings_enriched, order_newest_first
from wrenchflow.operators.intervals import schedule_conflicts
from wrenchflow.sources.tables import Garage


def _g(garage, **frames):
    return Garage(**{**garage.as_dict(), **frames})


def test_t6_newest_first_puts_null_dates_first(spark):
    df = spark.createDataFrame([("a", dt.date(2001, 1, 1), 480), ("b", None, 480), ("c", dt.date(2001, 1, 2), 480)],
                               "id string, booking_date date, start_min int")
    assert [r.id for r in order_newest_first(df).collect()] == ["b", "c", "a"]


def test_t13_inclusive_last_day_on_timestamps(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 31, 18, 0),), (dt.datetime(2000, 2, 1, 0, 0),)], "ts timestamp_ntz")
    assert df.where(between_dates("ts", "2000-01-01", "2000-01-31")).count() == 1
    assert df.where(between_dates("ts", "2000-01-01", "2000-01-31", inclusive_day=False)).count() == 0


def test_t14_last_n_days_has_no_upper_bound(spark):
    df = spark.createDataFrame([(dt.date(2001, 7, 1),), (dt.date(2030, 1, 1),), (dt.date(2001, 6, 1),)], "d date")
    assert df.where(last_n_days("d", 30, "2001-07-15")).count() == 2


def test_t12_t23_empty_ranges_give_zero(garage):
    fb = A.feedback_report_summary(garage, "2090-01-01", "2090-12-31").first()
    assert (fb.total_testimonials, fb.average_rating, fb.satisfaction_rate) == (0, 0.0, 0)
    assert A.potential_revenue(garage, "month", "2090-06-15").first().potential == 0
    top = A.insight_top_service(garage, "month", "2090-06-15").first()
    assert (top.name, top.bookings) == ("No data", 0)


def test_t18_previous_period_shares_boundary(garage):
    import math
    from wrenchflow.functions.dates import insight_range
    s, e, ps, pe = insight_range("quarter", "2001-07-15")
    assert pe == s
    row = A.period_growth(garage, "quarter", "2001-07-15").first()
    if row.previous_bookings:
        x = (row.current_bookings - row.previous_bookings) * 100.0 / row.previous_bookings
        assert row.growth_rate == math.floor(x + 0.5)          # JavaScript Math.round
    else:
        assert row.growth_rate == 0


def test_t19_faithful_revenue_credits_unbooked_service(spark, garage):
    svc = garage.services.limit(2)
    ids = [r.id for r in svc.select("id").collect()]
    b = garage.bookings.where(F.col("service_id") == ids[0]).limit(3).withColumn(
        "booking_date", F.lit("2001-07-10").cast("date")).withColumn("status", F.lit("pending"))
    g = _g(garage, services=svc, bookings=b)
    faithful = {r.service_id: (r.booking_count, r.total_revenue)
                for r in A.bookings_by_service(g, "2001-07-15", 30, faithful=True).collect()}
    default = {r.service_id: (r.booking_count, r.total_revenue)
               for r in A.bookings_by_service(g, "2001-07-15", 30).collect()}
    price = {r.id: r.price for r in svc.collect()}
    n0 = b.count()
    assert faithful[ids[0]] == (n0, price[ids[0]] * n0) and default[ids[0]] == (n0, price[ids[0]] * n0)
    assert faithful[ids[1]] == (0, price[ids[1]])
    assert default[ids[1]] == (0, None)


def test_t20_joined_customer_name_wins(garage):
    b = garage.bookings.limit(5).withColumn("customer_name", F.lit("typed at the desk"))
    names = {r.customer_name for r in bookings_enriched(garage, b).collect()}
    assert "typed at the desk" not in names


def test_t22_conflicts_exclude_self_and_default_duration(spark, garage):
    b = spark.createDataFrame(
        [("B-1", 7, dt.date(2001, 7, 16), 480, 10**9, "confirmed"), ("B-2", 7, dt.date(2001, 7, 16), 500, 10**9, "confirmed"),
         ("B-3", 7, dt.date(2001, 7, 16), 600, 10**9, "confirmed"), ("B-4", 7, dt.date(2001, 7, 16), 480, 10**9, "cancelled")],
        "id string, mechanic_id long, booking_date date, start_min int, service_id long, status string")
    got = {r.id: r.conflict_count for r in schedule_conflicts(_g(garage, bookings=b)).collect()}
    # unknown service -> 60 minute default; B-1 [480,540) and B-2 [500,560) overlap; cancelled B-4 ignored
    assert got == {"B-1": 1, "B-2": 1, "B-3": 0}
