"""Carried scans, components and first-come choice against plain replays, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from wrenchflow.operators import changes as M
from wrenchflow.operators import intervals as IV
from wrenchflow.operators import vehicles as W
from wrenchflow.operators.ordered import Running, components, dealt, first_come, running
from wrenchflow.sources.tables import Garage


def test_running_values_of_a_hot_key_lie_in_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", None, f"k{i % 50}"]), rng.choice([None, i])) for i in range(5000)]
    df = spark.createDataFrame(rows, "o long, k string, v long").repartition(5)
    held = dealt(df, "k", ["o"], 8)
    assert held.where("k = 'hot'").select("_p").distinct().count() > 2
    out = running(held, "k", ["o"], {"first": Running(F.col("v")), "last": Running(F.col("v"), last=True),
                                     "before": Running(F.col("v"), inclusive=False),
                                     "last_before": Running(F.col("v"), last=True, inclusive=False)})
    seen = {}
    want = {}
    for o, k, v in rows:
        past = seen.setdefault(k, [])
        now = past + ([v] if v is not None else [])
        want[o] = (now[0] if now else None, now[-1] if now else None, past[0] if past else None, past[-1] if past else None)
        seen[k] = now[:1] + now[-1:] if len(now) > 1 else now
    got = {r.o: (r["first"], r["last"], r.before, r.last_before) for r in out.collect()}
    assert got == want


def test_components_of_chains_hubs_and_repeats(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5001), (5001, 5000), (5000, 5000)]
    random.Random(2).shuffle(edges)
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(301)) and all(roots[1000 + i] == 1000 for i in range(400))
    assert roots[5000] == roots[5001] == 5000 and len(roots) == 703
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def _first_come(rows):
    taken, out = [set(), set()], {}
    for n, *keys in sorted(rows):
        out[n] = all(k is None or k not in t for k, t in zip(keys, taken))
        if out[n]:
            for k, t in zip(keys, taken):
                t.add(k)
    return out


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_first_come_equals_replay(spark, rounds):
    rng = random.Random(3)
    rows = [(i, rng.choice(["P", None, f"p{rng.randint(0, 40)}"]), rng.choice([None, f"v{rng.randint(0, 40)}"])) for i in range(400)]
    chain = [(1000 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(120)]  # each row conflicts with its neighbours only
    df = spark.createDataFrame(rows + chain, "n long, a string, b string").repartition(3)
    got = {r.n: r.accepted for r in first_come(df, "n", ["a", "b"], rounds).collect()}
    assert got == _first_come(rows + chain)
    assert [got[1000 + i] for i in range(120)] == [i % 2 == 0 for i in range(120)]


VEHICLE = ("request_seq long, role string, requester_customer_id long, customer_id long, make string, model string, year int, "
           "license_plate string, vin string, color string")


def test_new_vehicles_one_by_one(spark, garage):
    stored = [(r.license_plate, r.vin) for r in garage.vehicles.select("license_plate", "vin").collect()]
    rng = random.Random(4)
    rows = []
    for i in range(300):
        plate = rng.choice([f"Q {rng.randint(0, 60)}", stored[i][0], None, ""]) if i % 3 else "HOT"
        vin = rng.choice([f"Z{rng.randint(0, 60)}", stored[i][1], None, ""])
        rows.append((i // 2, rng.choice(["customer", "customer", "staff", "admin", "mechanic", None]), 5, rng.choice([None, 0, 7]),
                     rng.choice(["A", "A", "A", ""]), "m", rng.choice([2000, 2000, 0]), plate, vin, None))
    plates, vins = {p for p, _ in stored}, {v for _, v in stored if v}
    got = sorted(W.apply_new_vehicles(garage, spark.createDataFrame(rows, VEHICLE)).collect(), key=lambda r: (r.id is None, r.id or 0))
    low = lambda x: (x is not None, x or "")
    cust = lambda r: r[2] if r[1] == "customer" else r[3] if r[1] in ("staff", "admin") else None
    want = []
    for r in sorted(rows, key=lambda r: (r[0], low(r[7]), low(r[8]), low(cust(r)) if cust(r) is not None else (False, ""))):
        _, role, _, customer, make, _, year, plate, vin, _ = r
        if not (make and year and plate):
            why = W.R_VEHICLE_REQUIRED
        elif role in ("staff", "admin") and not customer:
            why = W.R_VEHICLE_CUSTOMER
        elif role not in ("staff", "admin", "customer"):
            why = W.R_VEHICLE_ROLE
        else:
            why = W.R_PLATE_TAKEN if plate in plates else W.R_VIN_TAKEN if vin and vin in vins else None
        if why is None:
            plates.add(plate)
            vins.add(vin)
        want.append((r[0], plate, vin, why))
    assert sorted(((r.request_seq, r.license_plate, r.vin, r.reject_reason) for r in got), key=str) == sorted(want, key=str)
    new = [r.id for r in got if r.id is not None]
    top = garage.vehicles.agg(F.max("id")).first()[0]
    assert new == list(range(top + 1, top + 1 + len(new)))
    after = W.vehicles_after(garage, W.apply_new_vehicles(garage, spark.createDataFrame(rows, VEHICLE)))
    assert after.groupBy("license_plate").count().where("count > 1").isEmpty()


TASK = "change_seq long, ref string, mechanic_id long, status string, now_min int"


def test_task_changes_one_by_one_with_repeated_numbers_and_a_hot_task(spark, garage):
    """Random changes of few tasks, several under one number; one booking has a third of all of them."""
    rng = random.Random(5)
    with_task = garage.mechanic_tasks.select(F.col("booking_id").alias("t"))
    fresh = [(r.id, r.mechanic_id, r.start_min) for r in garage.bookings.where("mechanic_id is not null")
             .join(with_task, F.col("id") == F.col("t"), "left_anti").limit(20).collect()]
    tasks = garage.mechanic_tasks.limit(30).collect()
    book = {r.id: r.mechanic_id for r in garage.bookings.collect()}
    state = {}
    changes = []
    for i in range(1500):
        status = rng.choice(["pending", "in-progress", "completed", "lost"])
        if i % 3 == 0:
            ref, mech = fresh[0][:2]
        elif i % 3 == 1:
            ref, mech = rng.choice(fresh)[:2]
        else:
            t = rng.choice(tasks)
            ref, mech = rng.choice([str(t.id), t.booking_id]), rng.choice([t.mechanic_id, -1])
        changes.append((i // 4, ref, mech, status, rng.choice([480, 500, 510, 570, 600])))
    for b, m, start in fresh:
        state[b, m] = None, start, True
    for t in tasks:
        state[t.booking_id, t.mechanic_id] = t.start_min, t.end_min, False
    of_task = {str(t.id): t for t in tasks}
    want = []
    for seq, ref, mech, status, now in sorted(changes, key=lambda c: (c[0], c[1], c[2], c[4])):
        key = (of_task[ref].booking_id, mech) if ref in of_task else (ref, mech)
        if status == "lost" or key not in state or book.get(key[0]) != mech:
            want.append((seq, ref, mech, status, None, None, None))
            continue
        s, e, new = state[key]
        s = now if new else s
        if status == "in-progress" and (s is None or s == e):
            s = now
        if status == "completed" and e is None:
            e = now
        state[key] = s, e, False
        want.append((seq, ref, mech, status, new, s, e))
    df = spark.createDataFrame(changes, TASK).repartition(4)
    got = [(r.change_seq, r.ref, r.mechanic_id, r.status, r.task_created, r.start_min, r.end_min) for r in M.apply_task_status(garage, df).collect()]
    # rows alike in number, task and time may follow each other either way: compare those that are told apart
    keyed = {}
    for c in changes:
        keyed[c[0], c[1], c[2], c[4]] = keyed.get((c[0], c[1], c[2], c[4]), 0) + 1
    assert len(got) == len(changes)
    if all(n == 1 for n in keyed.values()):
        assert sorted(got, key=str) == sorted(want, key=str)


def test_task_times_follow_the_rule_for_every_short_history(spark):
    """All histories of up to four changes over few times, against the rule step by step."""
    import itertools
    steps = [(s, t) for s in ("in-progress", "completed") for t in (1, 2)]
    rows, want, n = [], {}, 0
    for size in (1, 2, 3, 4):
        for history in itertools.product(steps, repeat=size):
            for s0, e0, new in [(None, None, False), (None, 1, False), (1, 1, False), (2, None, False), (None, 2, True), (None, None, True)]:
                n += 1
                start, end = s0, e0
                for k, (status, t) in enumerate(history):
                    start = t if new and k == 0 else start
                    if status == "in-progress" and (start is None or start == end):
                        start = t
                    if status == "completed" and end is None:
                        end = t
                    rows.append((f"t{n}", len(rows), status, t, new, s0, e0))
                    want[len(rows) - 1] = start, end
    df = spark.createDataFrame(rows, "_task string, _row long, status string, now_min int, new boolean, start_min int, end_min int")
    assert {r._row: (r._start, r._end) for r in M._task_times(df).collect()} == want


def test_a_hot_date_is_replayed_in_many_tasks(spark, garage):
    """All requests fall on one date: components of bookings and mechanics spread over the partitions."""
    date = garage.bookings.first().booking_date
    n = 240
    b = spark.createDataFrame([(f"B-{k}", date, 600 + k % 3 * 20, 1, "pending") for k in range(n)],
                              "id string, booking_date date, start_min int, service_id long, status string")
    s = spark.createDataFrame([(1, 30)], "id long, estimated_time int")
    mechs = spark.createDataFrame([(m,) for m in range(60)], "id long")
    a = spark.createDataFrame([(m, d, 0, 1440) for m in range(60) for d in range(7)], "mechanic_id long, day_of_week int, start_min int, end_min int")
    g = Garage(**(garage.as_dict() | {"bookings": b.withColumn("mechanic_id", F.lit(None).cast("long")), "services": s,
                                      "mechanics": mechs, "mechanic_availability": a}))
    reqs = spark.createDataFrame([(f"B-{k}", k // 4, k) for k in range(n)], "booking_id string, mechanic_id long, request_seq long")
    out = IV.assign_mechanics(g, reqs)
    got = {r.request_seq: r.reject_reason for r in out.collect()}
    for m in range(60):
        held = []
        for k in range(4 * m, 4 * m + 4):
            start = 600 + k % 3 * 20
            free = all(start >= e or start + 30 <= s for s, e in held)
            assert (got[k] is None) == free
            if free:
                held.append((start, start + 30))
    live = IV.booking_intervals(g, assigned_only=False)
    slots = reqs.join(live.drop("mechanic_id"), reqs.booking_id == live.id).select("booking_id", "mechanic_id", "booking_date", "start_min", "end_min")
    assert IV._contested(slots).select("mechanic_id", "island").distinct().count() == 60
