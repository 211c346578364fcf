"""Batch state changes whose rows reach the rarer branches: missing dates, staff reassignments, repeats, dangling keys."""

import pytest
from pyspark.sql import functions as F

from wrenchflow.operators import changes as M
from wrenchflow.operators.enrich import recent_bookings
from wrenchflow.sources import sinks
from wrenchflow.sources.tables import Garage

REQ = ("request_seq long, role string, requester_customer_id long, customer_id long, service_id long, vehicle_id long, "
       "booking_date string, booking_time string, notes string, mechanic_id long, customer_name string, "
       "payment_method string, is_down_payment string, down_payment_percent int, down_payment_amount decimal(12,2)")


def _req(seq, role, who, customer, service, vehicle, date="2024-01-02"):
    return (seq, role, who, customer, service, vehicle, date, "09:00", None, None, None, "cash", "false", 0, None)


def test_only_valid_requests_adopt_and_staff_reassign(spark, garage):
    s = garage.services.where("in_stock and id > 0").first().id
    v = garage.vehicles.where("id > 0").orderBy("id").first().id
    g = Garage(**(garage.as_dict() | {"vehicles": garage.vehicles.withColumn(
        "customer_id", F.when(F.col("id") != v, F.col("customer_id")))}))
    rows = [_req(1, "customer", 11, None, s, v, None), _req(2, "customer", 12, None, s, v), _req(3, "customer", 11, None, s, v),
            _req(4, "staff", None, 11, s, v), _req(5, "customer", 11, None, s, v), _req(6, "customer", 12, None, s, v)]
    out = {r.request_seq: r for r in M.apply_new_bookings(g, spark.createDataFrame(rows, REQ)).collect()}
    assert [out[k].reject_reason for k in range(1, 7)] == [
        M.R_REQUIRED_BOOKING, None, M.R_VEHICLE_NOT_OWNED, None, None, M.R_VEHICLE_NOT_OWNED]
    assert [out[k].vehicle_owner_after for k in (2, 4, 5)] == [12, 11, 11]


def test_completion_survives_a_later_status(spark, garage):
    b = garage.bookings.where(F.col("mechanic_id").isNotNull() & F.col("completed_at").isNull()).first()
    rows = [(1, b.id, "completed", "mechanic", b.mechanic_id), (2, b.id, "in-progress", "mechanic", b.mechanic_id)]
    ch = spark.createDataFrame(rows, "change_seq long, booking_id string, new_status string, actor_role string, actor_mechanic_id long")
    applied = M.apply_status_changes(garage, ch, "2024-05-01 17:00:00")
    after = M.bookings_after_status_changes(garage, applied).where(F.col("id") == b.id).first()
    assert after.status == "in-progress" and str(after.completed_at) == "2024-05-01 17:00:00"


def test_a_task_is_created_once(spark, garage):
    tasks = garage.mechanic_tasks.select(F.col("booking_id").alias("t"))
    b = (garage.bookings.where(F.col("mechanic_id").isNotNull())
         .join(tasks, F.col("id") == F.col("t"), "left_anti").first())
    rows = [(1, b.id, b.mechanic_id, "in-progress", 500), (2, b.id, b.mechanic_id, "in-progress", 510), (3, b.id, b.mechanic_id, "completed", 520)]
    ch = spark.createDataFrame(rows, "change_seq long, ref string, mechanic_id long, status string, now_min int")
    out = {r.change_seq: r for r in M.apply_task_status(garage, ch).collect()}
    assert [out[k].task_created for k in (1, 2, 3)] == [True, False, False]
    assert {(out[k].start_min, out[k].end_min) for k in (1, 2, 3)} == {(500, b.start_min)}
    assert [out[k].completed_min for k in (1, 2, 3)] == [None, None, 520]


@pytest.mark.parametrize("what", ["users", "services"])
def test_deletes_leave_no_dangling_keys(spark, garage, what):
    def dangling(g):
        ids = g.bookings.select(F.col("id").alias("b"))
        return [getattr(g, t).where(F.col("booking_id").isNotNull()).join(ids, F.col("booking_id") == F.col("b"), "left_anti").count()
                for t in ("payments", "mechanic_tasks", "field_notes")]
    if what == "users":
        gone = garage.customers.orderBy("id").limit(5).select("user_id")
        after = M.cascade_delete_users(garage, gone)
    else:
        after = M.delete_services(garage, garage.services.orderBy("id").limit(20).select(F.col("id").alias("service_id")))
    assert after.bookings.count() < garage.bookings.count()
    assert dangling(after) == dangling(garage)


def test_users_need_mail_name_and_known_role(spark, garage):
    u = garage.users.first()
    rows = [(1, None, "A", "customer"), (2, "a@x", "", "customer"), (3, "b@x", "B", "pirate"), (4, u.email, "C", "customer"),
            (5, "c@x", "C", "customer"), (6, "c@x", "D", "customer"), (7, u.email.upper() + "X", "E", "owner")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "row_seq long, email string, name string, role string, "
                               "specialization string, experience int, address string")
    out = {r.row_seq: r.reject_reason for r in M.provision_users(garage, df).collect()}
    assert out == {1: M.R_USER_REQUIRED, 2: M.R_USER_REQUIRED, 3: M.R_USER_ROLE, 4: M.R_EMAIL_IN_USE, 5: None, 6: M.R_EMAIL_IN_USE, 7: None}


def test_a_cut_comes_after_the_joins(garage):
    keep = garage.customers.orderBy("id").limit(20)
    g = Garage(**(garage.as_dict() | {"customers": keep}))
    own = garage.bookings.join(keep.select(F.col("id").alias("c")), F.col("customer_id") == F.col("c"), "left_semi").count()
    assert recent_bookings(g, 10).count() == min(10, own)


def test_sinks_return_their_own_run_with_nulls(spark, tmp_path):
    df = spark.createDataFrame([("m", None, 1)], "report_type string, average_rating double, n int")
    for _ in range(2):
        got = sinks.append_report(df, str(tmp_path / "r")).collect()
        assert [tuple(r) for r in got] == [("m", None, 1)]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert sinks.append_audit_log(df, str(tmp_path / "a")).count() == 1
    assert sinks.append_audit_log(df, str(tmp_path / "a")).count() == 1


def test_repeated_sequence_numbers_accept_one_row(spark, garage):
    """Rows of one number follow each other: the second of two equal requests is refused, never both accepted."""
    b = garage.bookings.where("status = 'pending'").first()
    rows = [(1, b.id, b.customer_id, 9)] * 2 + [(1, b.id, b.customer_id, 8)]
    ch = spark.createDataFrame(rows, "request_seq long, booking_id string, customer_id long, user_id long").repartition(3)
    out = M.apply_cancellations(garage, ch).collect()
    assert sorted(r.reject_reason is None for r in out) == [False, False, True]

    users = spark.createDataFrame([(5, "new@x.org", "N M", "customer", None, None, None)] * 2,
                                  "row_seq long, email string, name string, role string, specialization string, experience int, address string")
    assert [r.reject_reason for r in M.provision_users(garage, users).orderBy("user_id").collect()].count(None) == 1

    s, c = garage.services.where("id > 0").first().id, garage.customers.where("id > 0").first().id
    seen = spark.createDataFrame([(7, c, s, None, 5, "fine")] * 3,
                                 "submission_seq long, customer_id long, service_id long, mechanic_id long, rating int, comment string")
    stored = garage.testimonials.where((F.col("customer_id") == c) & (F.col("service_id") == s) & F.col("mechanic_id").isNull()).count()
    assert sum(r.reject_reason is None for r in M.apply_testimonials(garage, seen, "2024-01-01").collect()) == (0 if stored else 1)

    rows = [(1, b.id, "confirmed", "staff", None), (1, b.id, "completed", "staff", None), (1, b.id, "confirmed", "staff", None)]
    ch = spark.createDataFrame(rows, "change_seq long, booking_id string, new_status string, actor_role string, actor_mechanic_id long")
    applied = M.apply_status_changes(garage, ch, "2024-05-01 17:00:00")
    after = M.bookings_after_status_changes(garage, applied)
    assert after.count() == garage.bookings.count() and after.where(F.col("id") == b.id).first().status == "confirmed"
