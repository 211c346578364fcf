"""Batches move their rows few times: each table once, keys without a crowd in one shuffle, nothing that nobody reads."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from wrenchflow import session
from wrenchflow.operators import after as V
from wrenchflow.operators import changes as M
from wrenchflow.operators import intervals as IV
from wrenchflow.operators import ordered
from wrenchflow.operators.ordered import Running, carried
from wrenchflow.plans import catalog
from wrenchflow.plans import queries as Q
from wrenchflow.plans import standins as SI
from wrenchflow.session import stored
from wrenchflow.sources import binding

SF = "/root/testdata/sf0.001"


def _rows(df):
    return Counter(map(str, df.collect()))


def test_a_merged_version_opens_only_the_tables_that_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_GARAGES", {})
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: str(tmp_path / "g"))
    g = catalog.garage_for(spark, SF)
    decided = M.apply_payment_decisions(g, SI.payment_decisions(g))
    assert V.merged(g, V.after_payment_decisions(g, decided)).payments.count() == g.payments.count()
    assert not any((tmp_path / "g" / t).exists() for t in ("users", "activity_log", "testimonials", "field_notes", "vehicles"))


def test_a_version_made_by_one_join_is_the_one_of_the_changed_rows(spark, garage):
    for changes in (V.after_payment_decisions(garage, Q.q_apply_payment_decisions(garage)), V.after_moderation(garage, Q.q_moderate_testimonials(garage)),
                    V.after_assignments(garage, Q.q_assign_mechanics(garage)),
                    V.after_task_status(garage, M.apply_task_status(garage, SI.task_status_changes(garage)))):
        one, two = V.merged(garage, changes), V.merged(garage, dict(changes))
        assert changes.whole.keys() == changes.keys()
        for table in changes:
            assert _rows(getattr(one, table)) == _rows(getattr(two, table))


def test_a_row_without_id_or_with_a_repeated_one_keeps_its_place_in_a_version(spark):
    table = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (2, "d")], "id long, status string")
    last = spark.createDataFrame([(1, None), (9, "x")], "_key long, _status string")
    got = V._with_updates(table, last, status=F.col("_status"))
    assert _rows(got.select("id", "status")) == _rows(spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "d")], table.schema))


def test_carried_values_of_hot_and_other_keys_equal_a_window(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{rng.randrange(200)}", rng.choice([None, i])) for i in range(900)]
    df = stored(spark.createDataFrame(rows, "o long, k string, v long"))
    wanted = {"first": Running(F.col("v")), "before": Running(F.col("v"), last=True, inclusive=False)}
    out = carried(df, "k", ["o"], lambda r, scan: scan(r, "k", ["o"], wanted))
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("*", F.first("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
                     F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    assert _rows(out.where("k is not null")) == _rows(want.where("k is not null"))
    assert out.where("k is null").count() == want.where("k is null").count()


def test_task_times_without_a_hot_task_are_scanned_where_they_lie(spark, garage, monkeypatch):
    changes = SI.task_status_changes(garage)
    usual = _rows(M.apply_task_status(garage, changes))
    dealt = []
    monkeypatch.setattr(M, "dealt", lambda *a, **k: dealt.append(a) or ordered.dealt(*a, **k))
    kept = ordered.dealt
    monkeypatch.setattr(ordered, "dealt", lambda *a, **k: dealt.append(a) or kept(*a, **k))
    assert _rows(M.apply_task_status(garage, changes)) == usual and not dealt


def test_moderation_is_dealt_by_its_rows_not_by_the_session(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    real, found = ordered.dealt, []

    def dealt(*a):
        found.append(real(*a))
        return found[-1]
    monkeypatch.setattr(M, "dealt", dealt)
    df = spark.range(2000).selectExpr("id % 3 as k", "id as seq", "if(id % 5 = 0, id, null) as v")
    out = M.segmented_last(df, "k", "seq", "v", "prev")
    assert out.count() == 2000 and found[0].select("_p").distinct().count() >= 15


def test_overlaps_by_day_are_those_of_overlap_counts(spark):
    rng = random.Random(5)

    def some(n):
        for i in range(n):
            s = rng.choice([None, *range(0, 300, 7)])
            yield i, rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, "a", "b"]), s, None if s is None else s + rng.choice([-5, 0, 0, 7, 30])
    kind = "id int, m int, d string, start_min int, end_min int"
    probes, intervals = (spark.createDataFrame(list(some(n)), kind) for n in (300, 500))
    probes = probes.where("end_min is null or end_min >= start_min")
    got, want = (_rows(f(probes, intervals, ["m", "d"])) for f in (IV.overlaps_by_day, IV.overlap_counts))
    assert got == want


def test_assignments_look_the_duration_of_a_booking_up_once(garage, monkeypatch):
    real, calls = IV.booking_intervals, []
    monkeypatch.setattr(IV, "booking_intervals", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert IV.assign_mechanics(garage, Q.visit_assignment_requests(garage)).count()
    assert len(calls) == 1


def test_bookings_are_written_from_job_rows_without_a_shuffle(spark, tmp_path):
    bound = binding.bind(spark, SF, str(tmp_path / "jobs"))
    plan = bound.bookings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [l_shipdate" in plan
