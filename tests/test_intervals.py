"""Interval operators against brute force (pairs enumerated in Python on small fixtures)."""

import random

import pandas as pd
from pyspark.sql import functions as F

from wrenchflow.operators.intervals import assign_mechanics, overlap_counts, schedule_conflicts
from wrenchflow.plans.queries import visit_assignment_requests


def _brute(probes, ivs):
    out = []
    for k, ps, pe in probes:
        out.append(sum(1 for k2, s, e in ivs if k2 == k and s < pe and e > ps and e >= s))
    return out


def test_overlap_counts_random_with_hot_key(spark):
    rnd = random.Random(7)
    ivs = []
    for _ in range(600):
        k = 1 if rnd.random() < 0.5 else rnd.randint(2, 6)      # key 1 holds half of all rows
        s = rnd.randint(0, 1400)
        ivs.append((k, s, s + rnd.choice([0, 1, 15, 30, 60, 90])))
    probes = [(rnd.randint(1, 6), s, s + rnd.choice([0, 1, 30, 60])) for s in
              (rnd.randint(0, 1400) for _ in range(300))]
    pdf = spark.createDataFrame(probes, "k long, ps int, pe int").withColumn("pid", F.monotonically_increasing_id())
    idf = spark.createDataFrame(ivs, "k long, start_min int, end_min int")
    got = overlap_counts(pdf, idf, ["k"], "ps", "pe").orderBy("pid").select("k", "ps", "pe", "n_overlap").toPandas()
    exp = _brute([tuple(r) for r in got[["k", "ps", "pe"]].itertuples(index=False)], ivs)
    assert got["n_overlap"].tolist() == exp


def test_schedule_conflicts_matches_pairs(garage):
    from wrenchflow.operators.intervals import booking_intervals
    iv = booking_intervals(garage).toPandas()
    got = schedule_conflicts(garage).toPandas().set_index("id")["conflict_count"]
    m = iv.merge(iv, on=["mechanic_id", "booking_date"])
    m = m[(m.start_min_y < m.end_min_x) & (m.end_min_y > m.start_min_x) & (m.id_x != m.id_y)]
    exp = m.groupby("id_x").size()
    for bid, n in got.items():
        assert n == exp.get(bid, 0)


def _sequential(garage, reqs):
    """The reference's calls one by one over plain Python objects."""
    est = {r.id: r.estimated_time or 60 for r in garage.services.select("id", "estimated_time").collect()}
    book = {r.id: r for r in garage.bookings.select("id", "mechanic_id", "booking_date", "start_min", "status", "service_id").collect()}
    avail = {}
    for r in garage.mechanic_availability.collect():
        avail.setdefault((r.mechanic_id, r.day_of_week), []).append((r.start_min, r.end_min))
    mechs = {r.id for r in garage.mechanics.select("id").collect()}
    slots, where = {}, {}
    for r in book.values():
        if r.mechanic_id is not None and r.status != "cancelled":
            slots.setdefault((r.mechanic_id, r.booking_date), {})[r.id] = (r.start_min, r.start_min + est.get(r.service_id, 60))
            where[r.id] = (r.mechanic_id, r.booking_date)
    out = {}
    for q in sorted(reqs, key=lambda q: q[2]):
        r = book.get(q[0])
        if r is None:
            out[q[2]] = "booking not found"
            continue
        if q[1] not in mechs:
            out[q[2]] = "mechanic not found"
            continue
        s, e = r.start_min, r.start_min + est.get(r.service_id, 60)
        if not any(a <= s and e <= z for a, z in avail.get((q[1], (r.booking_date.weekday() + 1) % 7), [])):
            out[q[2]] = "outside availability"
            continue
        day = slots.setdefault((q[1], r.booking_date), {})
        out[q[2]] = any(a < e and z > s for other, (a, z) in day.items() if other != r.id)
        if not out[q[2]]:
            slots.get(where.get(r.id), {}).pop(r.id, None)
            day[r.id], where[r.id] = (s, e), (q[1], r.booking_date)
    return out


def _check(garage, reqs):
    got = {r.request_seq: r for r in assign_mechanics(garage, reqs).collect()}
    want = _sequential(garage, [(r.booking_id, r.mechanic_id, r.request_seq) for r in reqs.collect()])
    assert got.keys() == want.keys()
    for k, w in want.items():
        reason = got[k].reject_reason
        assert (reason in ("schedule conflict", "conflict within batch")) == (w is True), (got[k], w)
        assert reason == w or w in (True, False), (got[k], w)
        assert (got[k].task_status, got[k].new_status) == ((None, None) if reason else ("pending", "confirmed"))
    return got


def test_assign_mechanics_equals_calls_one_by_one(garage):
    got = _check(garage, visit_assignment_requests(garage))
    assert {r.reject_reason for r in got.values()} >= {None, "schedule conflict"}


def test_assign_mechanics_moves_and_repeats(spark, garage):
    """Random requests of few bookings and mechanics: repeats, moves, freed slots, unknown keys."""
    import random
    rng = random.Random(4)
    day = garage.bookings.groupBy("booking_date").count().orderBy(F.desc("count")).first().booking_date
    ids = [r.id for r in garage.bookings.where(F.col("booking_date") == day).select("id").collect()] + ["B-none"]
    mechs = [r.mechanic_id for r in garage.mechanic_availability.select("mechanic_id").distinct().orderBy("mechanic_id").limit(3).collect()]
    rows = [(rng.choice(ids), rng.choice(mechs + [-5]), k) for k in range(1, 120)]
    _check(garage, spark.createDataFrame(rows, "booking_id string, mechanic_id long, request_seq long"))


def test_assign_mechanics_long_chain(spark, garage):
    """300 requests of one mechanic and day, each overlapping the next: every second one wins, in one pass."""
    from wrenchflow.sources.tables import Garage
    date = garage.bookings.first().booking_date
    mech = garage.mechanics.select("id").first().id
    b = spark.createDataFrame([(f"B-{k}", date, 2 * k, 1, "pending") for k in range(300)],
                              "id string, booking_date date, start_min int, service_id long, status string")
    s = spark.createDataFrame([(1, 3)], "id long, estimated_time int")
    a = spark.createDataFrame([(mech, d, 0, 1440) for d in range(7)], "mechanic_id long, day_of_week int, start_min int, end_min int")
    g = Garage(**(garage.as_dict() | {"bookings": b.withColumn("mechanic_id", F.lit(None).cast("long")), "services": s,
                                      "mechanic_availability": a}))
    reqs = spark.createDataFrame([(f"B-{k}", mech, k) for k in range(300)], "booking_id string, mechanic_id long, request_seq long")
    out = {r.request_seq: r.reject_reason for r in assign_mechanics(g, reqs).collect()}
    assert all((out[k] is None) == (k % 2 == 0) for k in range(300))
