"""Row access: one principal's rows agree with the whole-table form, and with the rule read row by row."""

import pytest
from pyspark.sql import functions as F

from wrenchflow.operators import access as A
from wrenchflow.operators.listing import visible_bookings


def test_bookings_by_policy_equal_the_earlier_operator(garage):
    got = A.visible_rows(garage, "bookings").select("user_id", "role", F.col("row_id").alias("booking_id"), "scope")
    assert sorted(map(str, got.collect())) == sorted(map(str, visible_bookings(garage).collect()))


@pytest.mark.parametrize("table", ["vehicles", "field_notes", "testimonials", "users", "bookings"])
def test_one_principal_sees_what_the_table_says(garage, table):
    seen = A.visible_rows(garage, table).where("row_id is not null")
    users = garage.users.orderBy(F.xxhash64("id")).limit(4).collect()
    for u in users:
        own = {r.row_id for r in seen.where((F.col("user_id") == u.id) | F.col("user_id").isNull()).collect()}
        assert {r.id for r in A.rows_seen_by(garage, table, u.role, u.id).collect()} == own
    assert A.rows_seen_by(garage, table, "staff", 1).count() == getattr(garage, table).count()


def test_notes_follow_two_keys_to_the_mechanic(garage):
    user = {m.user_id: m.id for m in garage.mechanics.collect()}
    book = {b.id: b.mechanic_id for b in garage.bookings.collect()}
    u, m = next(iter(sorted(user.items())))
    want = {n.id for n in garage.field_notes.collect() if n.mechanic_id == m or book.get(n.booking_id) == m}
    assert want and {r.id for r in A.rows_seen_by(garage, "field_notes", "mechanic", u).collect()} == want
    assert A.rows_seen_by(garage, "field_notes", "customer", u).count() == 0


def test_anyone_sees_approved_testimonials_only(garage):
    rows = A.rows_seen_by(garage, "testimonials", "visitor", None)
    assert rows.count() == garage.testimonials.where("approved").count() and rows.where("not approved").isEmpty()
