"""Several tables change together: one commit, only touched parts rewritten, no dangling keys."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from wrenchflow.operators import after as V
from wrenchflow.operators import changes as M
from wrenchflow.plans import standins as SI
from wrenchflow.sources import versions as S
from wrenchflow.sources.binding import AS_OF


@pytest.fixture(scope="module")
def stored(spark, garage, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("shop"))
    assert S.latest(spark, base) == -1
    assert S.commit(spark, base, garage.as_dict()) == 0
    return base


def _rows(df):
    return sorted(map(str, df.collect()))


def test_first_commit_holds_every_table(spark, garage, stored):
    g = S.load_version(spark, stored, 0)
    for name, df in garage.as_dict().items():
        assert _rows(getattr(g, name).select(*df.columns)) == _rows(df), name


def test_a_batch_changes_all_its_tables_under_one_version(spark, garage, stored):
    g = S.load_version(spark, stored, 0)
    applied = M.apply_new_bookings(g, SI.new_booking_requests(g)).checkpoint()
    changes = V.after_new_bookings(g, applied, AS_OF)
    want = V.merged(g, changes)
    number = S.commit(spark, stored, changes)
    new, old = S.load_version(spark, stored), S.load_version(spark, stored, 0)
    assert number == S.latest(spark, stored) and number > 0
    assert _rows(old.bookings) == _rows(garage.bookings)
    for t in ("bookings", "payments", "vehicles", "customers", "users"):
        assert _rows(getattr(new, t)) == _rows(getattr(want, t)), t
    ids = new.bookings.select(F.col("id").alias("b"))
    assert new.payments.join(ids, F.col("booking_id") == F.col("b"), "left_anti").count() == \
        garage.payments.join(garage.bookings.select(F.col("id").alias("b")), F.col("booking_id") == F.col("b"), "left_anti").count()
    assert new.bookings.groupBy("id").count().where("count > 1").isEmpty()


def test_only_parts_with_changed_keys_are_rewritten(spark, stored):
    before = S.latest(spark, stored)
    g = S.load_version(spark, stored)
    one = g.bookings.where("status in ('pending', 'confirmed')").orderBy("booking_date", "id").limit(1).checkpoint()
    requests = one.select(F.lit(1).cast("long").alias("request_seq"), F.col("id").alias("booking_id"), "customer_id",
                          F.lit(1).cast("long").alias("user_id"))
    number = S.commit(spark, stored, V.after_cancellations(g, M.apply_cancellations(g, requests)))
    assert number == before + 1
    assert len(glob.glob(f"{stored}/data/bookings/version={number}/_part=*")) == 1
    assert not os.path.exists(f"{stored}/data/payments/version={number}")
    new = S.load_version(spark, stored)
    assert new.bookings.join(one.select("id"), "id").first().status == "cancelled"
    assert new.bookings.count() == g.bookings.count()


def test_a_moved_row_leaves_its_old_part_and_deletes_go(spark, stored):
    g = S.load_version(spark, stored)
    row = g.bookings.orderBy("id").limit(2).checkpoint()
    moved = row.limit(1).withColumn("booking_date", F.lit("1990-01-01").cast("date")).checkpoint()
    gone = row.join(moved.select("id"), "id", "left_anti").select("id").checkpoint()
    S.commit(spark, stored, {"bookings": moved}, {"bookings": gone})
    new = S.load_version(spark, stored)
    assert new.bookings.count() == g.bookings.count() - 1
    assert [str(r.booking_date) for r in new.bookings.join(moved.select("id"), "id").collect()] == ["1990-01-01"]
    assert new.bookings.join(gone, "id").isEmpty()


def test_a_run_that_fails_before_its_manifest_changes_nothing(spark, stored):
    before = S.latest(spark, stored)
    g = S.load_version(spark, stored)
    broken = g.customers.withColumn("address", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        S.commit(spark, stored, {"bookings": g.bookings.limit(3), "customers": broken})
    assert S.latest(spark, stored) == before
    assert _rows(S.load_version(spark, stored).customers) == _rows(g.customers)


def test_new_accounts_and_their_rows_share_one_key(spark, garage):
    new = V.merged(garage, V.after_provisioning(garage, M.provision_users(garage, SI.user_rows(garage))))
    users = new.users.select(F.col("id").alias("u"), "role")
    for t, role in (("customers", "customer"), ("mechanics", "mechanic")):
        rows = getattr(new, t)
        assert rows.join(users.where(F.col("role") == role), F.col("user_id") == F.col("u"), "left_anti").isEmpty()
        assert rows.count() > getattr(garage, t).count()
        assert users.where(F.col("role") == role).join(rows, F.col("user_id") == F.col("u"), "left_anti").isEmpty()


def test_a_part_left_empty_leaves_the_version(spark, garage, tmp_path):
    base = str(tmp_path)
    S.commit(spark, base, {"services": garage.services.limit(1)})
    S.commit(spark, base, {}, {"services": garage.services.select("id")})
    assert S.load_version(spark, base).services.count() == 0
