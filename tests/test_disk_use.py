"""Disk of large batches: shuffle and scratch files go once they are read, rows move no more often than they must."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_batch_moves import _rows
from wrenchflow import session
from wrenchflow.model import SCHEMAS
from wrenchflow.operators import after as V
from wrenchflow.operators import changes as M
from wrenchflow.operators import enrich as J
from wrenchflow.operators import ordered
from wrenchflow.operators import vehicles as W
from wrenchflow.operators.ordered import first_come
from wrenchflow.plans import queries as Q
from wrenchflow.plans import standins as SI
from wrenchflow.session import dropped, stored
from wrenchflow.sources.binding import AS_OF
from wrenchflow.sources.tables import Garage


@pytest.fixture
def shuffled(spark):
    """The session without broadcast joins, as with large tables."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _moves(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", _plan(df)))


def _shop(spark, **tables):
    return Garage(**{t: spark.createDataFrame([tuple(r.get(f.name) for f in s.fields) for r in tables.get(t, [])], s) for t, s in SCHEMAS.items()})


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {b for b in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if b.startswith("shuffle_")}
    before = files()
    out = stored(spark.range(5000).repartition(3, "id"))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_dropped_frame_leaves_no_files(spark):
    first = stored(spark.range(10))
    second = stored(first.selectExpr("id + 1 as id"), instead_of=(first,))
    assert not Path(first._kept_at.removeprefix("file:")).exists() and second.count() == 10
    dropped(second)
    assert not Path(second._kept_at.removeprefix("file:")).exists()


NOTE = "note_seq long, booking_id string, mechanic_id long, note string, date date"


def _notes(g, rows):
    """Plain reckoning: accepted from the booking's mechanic, newest by date and number."""
    of = {(b.id, b.mechanic_id) for b in g.bookings.select("id", "mechanic_id").collect() if b.mechanic_id is not None}
    out, newest = [], {}
    for seq, booking, mechanic, note, date in rows:
        why = M.R_NOTE_REQUIRED if not booking or not note else None if (booking, mechanic) in of else M.R_NOTE_NOT_ASSIGNED
        if not why and (date, seq) > newest.get(booking, ("", -1))[:2]:
            newest[booking] = (date, seq, note)
        out.append((seq, booking, why))
    return {(seq, booking, why, newest.get(booking, (None,))[-1]) for seq, booking, why in out}


@pytest.mark.parametrize("task_rows", [500_000, 60])
def test_notes_of_crowded_and_of_no_bookings_equal_a_plain_reckoning(spark, monkeypatch, task_rows):
    monkeypatch.setattr(session, "TASK_ROWS", task_rows)
    rng = random.Random(7)
    g = _shop(spark, bookings=[{"id": f"B-{i}", "mechanic_id": rng.choice([None, 1, 2, 3])} for i in range(40)])
    rows = [(i, rng.choice(["B-1", "B-2", None, "", f"B-{rng.randrange(60)}"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "", f"n{i}"]),
             f"2001-01-0{rng.randrange(1, 9)}") for i in range(600)]
    out = M.append_field_notes(g, spark.createDataFrame(rows, "note_seq long, booking_id string, mechanic_id long, note string, date string"))
    got = out.collect()
    assert len(got) == len(rows) and {(r.note_seq, r.booking_id, r.reject_reason, r.booking_note_after) for r in got} == _notes(g, rows)
    assert all((r.status == "pending") == (r.reject_reason is None) for r in got)


def test_notes_move_once_and_their_bookings_once(shuffled, garage):
    """by booking for the mechanic's check, the newest note and the new version alike."""
    notes = stored(SI.field_note_appends(garage))
    applied = M.append_field_notes(garage, notes)
    assert _moves(applied) == 2
    after = V.after_field_notes(garage, applied)
    assert _moves(V.merged(garage, after).bookings) == 3
    two = V.merged(garage, dict(after))
    assert _rows(V.merged(garage, after).bookings) == _rows(two.bookings)
    assert _rows(V.merged(garage, after).field_notes) == _rows(two.field_notes)


REQUEST = ("request_seq long, role string, requester_customer_id long, customer_id long, service_id long, vehicle_id long, booking_date string, "
           "booking_time string, notes string, mechanic_id long, customer_name string, payment_method string, is_down_payment string, "
           "down_payment_percent int, down_payment_amount decimal(12,2)")


def _requested(rng, n):
    for i in range(n):
        role = rng.choice(["customer", "customer", "staff", "admin", "mechanic", None])
        who = rng.choice([None, 1, 2, 3])
        yield (rng.randrange(n), role, who, rng.choice([None, 0, 1, 2]), rng.choice([0, 1, 1, 1, 2, 3, 9]), rng.choice([None, 0, 1, 1, 1, 2, 3, 4, 77]),
               rng.choice(["2001-01-02", "2001-01-02", "2001-01-02", None]), "10:00", f"n{i}", None, None, rng.choice([None, "cash"]), "true", 30, 5)


def _booked(g, rows):
    """Requests one by one, in order: (request_seq, note) with the owner after it and the refusal."""
    stock, owner = {s.id: s.in_stock for s in g.services.collect()}, {v.id: v.customer_id for v in g.vehicles.collect()}
    first = lambda x: (x is not None, x)
    out, number = {}, 0
    for seq, role, mine, named, service, vehicle, day, _, note, *_ in sorted(rows, key=lambda r: (r[0], first(r[5]), first(
            r[2] if r[1] == "customer" else r[3] if r[1] in ("staff", "admin") else None))):
        who = mine if role == "customer" else named if role in ("staff", "admin") else None
        why = (M.R_REQUIRED_BOOKING if not service or not vehicle or not day else M.R_SERVICE_NOT_FOUND if service not in stock
               else M.R_SERVICE_UNAVAILABLE if stock[service] is False else M.R_NOT_AUTHORIZED_CREATE if role == "mechanic"
               else M.R_CUSTOMER_REQUIRED if role in ("staff", "admin") and not who else M.R_VEHICLE_NOT_FOUND if vehicle not in owner else None)
        part = not why and stock[service] and role is not None
        if part and who is not None and (role != "customer" or owner[vehicle] is None):
            owner[vehicle] = who
        after = owner.get(vehicle)
        if not why and role == "customer" and after is not None and who is not None and after != who:
            why = M.R_VEHICLE_NOT_OWNED
        number += not why
        out[seq, note] = (after, why, None if why else f"B-{500 + number}")
    return out


@pytest.mark.parametrize("task_rows", [500_000, 50])
def test_bookings_of_crowded_and_of_no_vehicles_equal_a_plain_replay(spark, monkeypatch, task_rows):
    monkeypatch.setattr(session, "TASK_ROWS", task_rows)
    g = _shop(spark, bookings=[{"id": "B-500"}], services=[{"id": 1, "in_stock": True}, {"id": 2, "in_stock": False}, {"id": 3}],
              vehicles=[{"id": 1}, {"id": 2, "customer_id": 1}, {"id": 3}, {"id": 4, "customer_id": 2}])
    rows = [r for n, r in enumerate(_requested(random.Random(9), 400))]
    rows = list({(r[0], r[5], r[2], r[3], r[1]): r for r in rows}.values())
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    from decimal import Decimal
    frame = spark.createDataFrame([(*r[:-1], Decimal(r[-1])) for r in rows], REQUEST)
    got = {(r.request_seq, r.notes): (r.vehicle_owner_after, r.reject_reason, r.id) for r in M.apply_new_bookings(g, frame).collect()}
    assert got == _booked(g, rows)


def test_requests_move_once_to_their_vehicle_and_leave_no_spare_copies(shuffled, garage, monkeypatch):
    """neither numbered whole nor dealt twice; two tables are kept for the outcome besides the requests."""
    kept, real = [], session.stored
    for m in (M, ordered):
        monkeypatch.setattr(m, "stored", lambda df, instead_of=(): kept.append(real(df, instead_of)) or kept[-1])
    requests = SI.new_booking_requests(garage)
    applied = M.apply_new_bookings(garage, requests)
    assert applied.count() == requests.count()
    whole = garage.bookings.count()
    left = [f for f in kept if Path(f._kept_at.removeprefix("file:")).exists()]
    assert sum(f.count() >= whole for f in left) == 2
    assert sum(f.count() >= whole for f in left) + sum(f not in left for f in kept) == 3


@pytest.mark.parametrize("table,reads", [("bookings", 0), ("payments", 0), ("vehicles", 1), ("customers", 1)])
def test_versions_after_new_bookings_are_those_of_the_changed_rows(shuffled, garage, table, reads):
    """New keys are added without a join, new values set by one; payments are numbered when they are read."""
    applied = stored(Q.q_apply_new_bookings(garage))
    after = V.after_new_bookings(garage, applied, AS_OF)
    one = getattr(V.merged(garage, after), table)
    joins = _plan(one).count("SortMergeJoin")
    assert joins == reads
    assert callable(after.whole._frames["payments"]) == (table != "payments")
    assert _rows(one) == _rows(getattr(V.merged(garage, dict(after)), table))


VEHICLE = ("request_seq long, role string, requester_customer_id long, customer_id long, make string, model string, year int, license_plate string, "
           "vin string, color string")


def _registered(g, rows):
    plates, vins = {v.license_plate for v in g.vehicles.collect()} - {None}, {v.vin for v in g.vehicles.collect()} - {None}
    out, n = {}, max(v.id for v in g.vehicles.collect())
    for seq, role, mine, named, make, model, year, plate, vin, _ in sorted(rows):
        why = (W.R_VEHICLE_REQUIRED if not (make and model and year and plate) else W.R_VEHICLE_CUSTOMER if role in ("staff", "admin") and not named
               else W.R_VEHICLE_ROLE if role not in ("staff", "admin", "customer") else W.R_PLATE_TAKEN if plate in plates
               else W.R_VIN_TAKEN if vin and vin in vins else None)
        if not why:
            n += 1
            plates.add(plate)
            vins |= {vin} - {None, ""}
        out[seq] = (why, None if why else n)
    return out


@pytest.mark.parametrize("task_rows", [500_000, 60])
def test_registrations_equal_a_plain_replay_and_keep_one_copy_of_them(spark, monkeypatch, task_rows):
    """requests are stored once, in their order; files of finished steps go."""
    monkeypatch.setattr(session, "TASK_ROWS", task_rows)
    kept, real = [], session.stored
    for m in (M, W, ordered):
        monkeypatch.setattr(m, "stored", lambda df, instead_of=(): kept.append(real(df, instead_of)) or kept[-1])
    rng = random.Random(11)
    g = _shop(spark, vehicles=[{"id": i, "license_plate": f"p{i}", "vin": f"v{i}" if i % 2 else None} for i in range(20)])
    rows = [(i, rng.choice(["customer", "customer", "staff", "mechanic", None]), 1, rng.choice([None, 0, 5]), rng.choice(["m", "m", ""]), "x",
             rng.choice([0, 1999, 1999]), rng.choice(["hot", None, f"p{rng.randrange(150)}", f"q{i}"]), rng.choice([None, "", "hot", f"v{rng.randrange(90)}"]),
             "white") for i in range(700)]
    frame = spark.createDataFrame(rows, VEHICLE).repartition(3)
    out = W.apply_new_vehicles(g, frame)
    assert {r.request_seq: (r.reject_reason, r.id) for r in out.collect()} == _registered(g, rows)
    left = [f for f in kept if Path(f._kept_at.removeprefix("file:")).exists()]
    assert sum(f.count() >= len(rows) for f in left) == 1 and len(left) < len(kept)


def test_first_come_shows_its_keys_and_removes_its_own_files(spark, monkeypatch):
    kept, real = [], session.stored
    monkeypatch.setattr(ordered, "stored", lambda df, instead_of=(): kept.append(real(df, instead_of)) or kept[-1])
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(40)]
    out = first_come(spark.createDataFrame(rows, "n long, a string, b string"), "n", ["a", "b"], 1, keep=["a"])
    assert sorted((r.n, r.a, r.accepted) for r in out.collect()) == [(i, a, i % 2 == 0) for i, a, _ in rows]
    left = [f for f in kept if Path(f._kept_at.removeprefix("file:")).exists()]
    assert left == [out]


def test_assigned_bookings_move_once_for_customer_and_vehicle(shuffled, garage):
    """four moves of assigned bookings and tasks before, one less; notes come with the task, not after all."""
    wide = "customer_notes"
    outer, daily = J.mechanic_tasks_outer(garage), J.mechanic_daily_tasks(garage)
    for df in (outer, daily):
        joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", _plan(df))
        assert [sorted(re.sub(r"#\d+L?", "", k) for k in j.split(", ")) for j in joins[:2]] == [["customer_id", "vehicle_id"], ["service_id"]], joins
    assert wide in outer.columns and daily.count() == outer.count()


def test_tasks_and_notes_of_a_booking_meet_it_in_one_move(shuffled, garage):
    """both joins go by the booking alone, so its rows are not moved again for the notes."""
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", _plan(J.mechanic_daily_tasks(garage)))
    assert [re.sub(r"#\d+L?", "", j) for j in joins].count("id") >= 2
    days = garage.bookings.where("mechanic_id is not null").groupBy("booking_date").count().orderBy(F.desc("count"), "booking_date").first()
    some = J.mechanic_daily_tasks(garage, days.booking_date)
    assert _rows(some) == _rows(J.mechanic_daily_tasks(garage).where(F.col("booking_date") == days.booking_date)) and some.count() == days["count"]


def test_assigned_bookings_of_repeated_and_missing_dimension_rows(spark):
    g = _shop(spark, bookings=[{"id": f"B-{i}", "mechanic_id": i % 2 or None, "service_id": i % 3, "customer_id": i % 4 or None, "vehicle_id": i % 5 or None}
                               for i in range(60)],
              mechanic_tasks=[{"id": i, "booking_id": f"B-{i}", "mechanic_id": 1 + i % 4 // 2} for i in range(0, 60)],
              services=[{"id": 1, "name": "s"}, {"id": 1, "name": "t"}, {"id": 2, "name": "u"}], users=[{"id": i, "name": f"c{i}"} for i in range(4)],
              customers=[{"id": i, "user_id": i} for i in (1, 2, 2)], vehicles=[{"id": i, "make": f"v{i}"} for i in (1, 2, 3, 3)])
    plain = (g.bookings.where("mechanic_id is not null").alias("b")
             .join(g.mechanic_tasks.alias("t"), F.expr("b.id = t.booking_id and b.mechanic_id = t.mechanic_id"), "left")
             .join(g.services.alias("s"), F.expr("b.service_id = s.id")).join(g.customers.alias("c"), F.expr("b.customer_id = c.id"))
             .join(g.users.alias("u"), F.expr("c.user_id = u.id")).join(g.vehicles.alias("v"), F.expr("b.vehicle_id = v.id"))
             .selectExpr("b.id", "t.id as task_id", "s.name as service_name", "u.name as customer_name", "v.make"))
    want = Counter(map(tuple, plain.collect()))
    for df in (J.mechanic_tasks_outer(g), J.mechanic_daily_tasks(g)):
        assert Counter(map(tuple, df.select("id", "task_id", "service_name", "customer_name", "make").collect())) == want
    assert len(want) > 5
