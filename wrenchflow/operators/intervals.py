"""Interval logic: schedule conflicts, availability, free slots, assignment.

Times are minute-of-day integers within a date, so an interval is
``[start_min, end_min)`` under a key such as (mechanic_id, booking_date).

Overlap counting never pairs rows of a group.  For a probe ``[ps, pe)`` the
number of intervals of its key overlapping it is

    #{intervals with start < pe}  -  #{intervals with end <= ps}

(valid for every interval with start <= end; a zero-length interval lying
exactly on a zero-length probe is added back).  Both terms are running sums
over *pre-aggregated* histograms: intervals are first counted per
(key, start) and per (key, end) with a map-side partial aggregate, then one
window per key runs over the distinct time values (at most one row per
minute of the day plus the longest duration), and probes look their value
up with an equi-join.  A mechanic-day holding a third of all bookings
therefore costs the window one row per distinct minute, not one per
booking, and the look-up join's hot key is split by AQE's skew handling.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchflow.functions.exprs import end_min, hhmm, weekday0
from wrenchflow.functions.predicates import Date, _d
from wrenchflow.model import SLOT_STEP_MIN
from wrenchflow.operators.ordered import components
from wrenchflow.session import partitions_for, stored
from wrenchflow.sources.tables import Garage

R_NO_BOOKING, R_NO_MECHANIC = "booking not found", "mechanic not found"
R_OUTSIDE, R_CONFLICT, R_BATCH_CONFLICT = "outside availability", "schedule conflict", "conflict within batch"


def overlap_counts(probes: DataFrame, intervals: DataFrame, keys: list[str], probe_start: str = "start_min",
                   probe_end: str = "end_min", iv_start: str = "start_min", iv_end: str = "end_min",
                   out: str = "n_overlap") -> DataFrame:
    """Add ``out`` = number of ``intervals`` of the same key overlapping each probe.

    Overlap is ``iv_start < probe_end AND iv_end > probe_start`` (the
    reference's conflict predicate).  Intervals and probes are each scanned
    once and exploded into time events; one pre-aggregation gives, per
    (key, t), the starts, ends and zero-length intervals at t (probe times
    contribute zeros so every looked-up t exists); one running-sum window
    per key turns that into #{start < t} and #{end <= t}; both look-ups
    join the same table, so its shuffle is reused.  See the module
    docstring for the scalability argument.
    """
    iv = intervals.where(F.col(iv_start).isNotNull() & F.col(iv_end).isNotNull()
                         & (F.col(iv_end) >= F.col(iv_start)))
    kk = [f"_k{i}" for i in range(len(keys))]
    ren = [F.col(k).alias(a) for k, a in zip(keys, kk)]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    is_zero = F.when(F.col(iv_start) == F.col(iv_end), one).otherwise(zero)
    iv_events = iv.select(*ren, F.explode(F.array(
        F.struct(F.col(iv_start).alias("t"), one.alias("ws"), zero.alias("we"), is_zero.alias("wz")),
        F.struct(F.col(iv_end).alias("t"), zero.alias("ws"), one.alias("we"), zero.alias("wz")))).alias("_ev"))
    probe_events = probes.select(*ren, F.explode(F.array(
        F.struct(F.col(probe_start).alias("t"), zero.alias("ws"), zero.alias("we"), zero.alias("wz")),
        F.struct(F.col(probe_end).alias("t"), zero.alias("ws"), zero.alias("we"), zero.alias("wz")))).alias("_ev"))
    events = iv_events.unionByName(probe_events).select(*kk, "_ev.*")
    hist = events.groupBy(*kk, "t").agg(F.sum("ws").alias("ws"), F.sum("we").alias("we"), F.sum("wz").alias("wz"))
    w = Window.partitionBy(*kk).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select(*kk, "t", (F.sum("ws").over(w) - F.col("ws")).alias("s_lt"),
                      F.sum("we").over(w).alias("e_le"), F.col("wz").alias("z_at"))
    a, b = cum.alias("_a"), cum.alias("_b")
    j = (probes.alias("_p")
         .join(a, [*[F.col(f"_p.{k}") == F.col(f"_a.{x}") for k, x in zip(keys, kk)],
                   F.col(f"_p.{probe_end}") == F.col("_a.t")], "left")
         .join(b, [*[F.col(f"_p.{k}") == F.col(f"_b.{x}") for k, x in zip(keys, kk)],
                   F.col(f"_p.{probe_start}") == F.col("_b.t")], "left"))
    # the difference over-subtracts a zero-length interval sitting exactly on a zero-length probe
    z = F.when(F.col(f"_p.{probe_start}") == F.col(f"_p.{probe_end}"), F.coalesce(F.col("_b.z_at"), F.lit(0)))
    n = (F.coalesce(F.col("_a.s_lt"), F.lit(0)) - F.coalesce(F.col("_b.e_le"), F.lit(0))
         + F.coalesce(z, F.lit(0)))
    return j.select("_p.*", n.alias(out))


def overlaps_by_day(probes: DataFrame, intervals: DataFrame, keys: list[str], out: str = "n_overlap") -> DataFrame:
    """``overlap_counts`` for large sets of probes, which move once.

    Starts and ends are counted per (key, minute), combined before the shuffle, and a key's minutes form one array: at most
    a row per minute of the day plus the longest duration, however many intervals the key has.  That one row per
    key meets the probes, and both sums run over its array; a probe reads minutes, never intervals.
    """
    iv = intervals.where(F.col("start_min").isNotNull() & F.col("end_min").isNotNull() & (F.col("end_min") >= F.col("start_min")))
    kk = [f"_k{i}" for i in range(len(keys))]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    is_zero = F.when(F.col("start_min") == F.col("end_min"), one).otherwise(zero)
    events = iv.select(*[F.col(k).alias(a) for k, a in zip(keys, kk)], F.explode(F.array(
        F.struct(F.col("start_min").alias("t"), one.alias("ws"), zero.alias("we"), is_zero.alias("wz")),
        F.struct(F.col("end_min").alias("t"), zero.alias("ws"), one.alias("we"), zero.alias("wz")))).alias("_ev")).select(*kk, "_ev.*")
    minutes = events.groupBy(*kk, "t").agg(F.sum("ws").alias("ws"), F.sum("we").alias("we"), F.sum("wz").alias("wz"))
    days = minutes.groupBy(*kk).agg(F.collect_list(F.struct("t", "ws", "we", "wz")).alias("_minutes"))
    start, end = F.col("start_min"), F.col("end_min")

    def added(n: Column, m: Column) -> Column:
        # as in overlap_counts, a zero-length interval on a zero-length probe is added back
        return (n + F.when(m["t"] < end, m["ws"]).otherwise(zero) - F.when(m["t"] <= start, m["we"]).otherwise(zero)
                + F.when((start == end) & (m["t"] == start), m["wz"]).otherwise(zero))
    n = F.coalesce(F.aggregate("_minutes", zero, added), zero)
    return (probes.join(days, [F.col(k) == F.col(a) for k, a in zip(keys, kk)], "left").withColumn(out, n).drop(*kk, "_minutes"))


def booking_intervals(g: Garage, bookings: DataFrame | None = None, live_only: bool = True,
                      assigned_only: bool = True) -> DataFrame:
    """Bookings as intervals: [start, start + service estimate (default 60)).

    By default only live (not cancelled) bookings with a mechanic.
    """
    b = bookings if bookings is not None else g.bookings
    if assigned_only:
        b = b.where(F.col("mechanic_id").isNotNull())
    if live_only:
        b = b.where(F.col("status") != "cancelled")
    dur = g.services.select(F.col("id").alias("_sid"), "estimated_time")
    return (b.join(dur, F.col("service_id") == F.col("_sid"), "left")
            .select("id", "mechanic_id", "booking_date", "start_min",
                    end_min("start_min", "estimated_time").alias("end_min"), "status"))


def schedule_conflicts(g: Garage) -> DataFrame:
    """Per live assigned booking, how many other live bookings of the same
    mechanic on the same date overlap it.

    Cancelled bookings neither conflict nor are checked; the booking itself
    is excluded (T22: the reference counted it).
    """
    iv = booking_intervals(g)
    counted = overlap_counts(iv, iv, ["mechanic_id", "booking_date"])
    return counted.select("id", "mechanic_id", "booking_date", "start_min", "end_min",
                          (F.col("n_overlap") - 1).alias("conflict_count"),
                          (F.col("n_overlap") > 1).alias("has_conflict"))


def within_availability(g: Garage, intervals: DataFrame | None = None) -> DataFrame:
    """Flag each assigned booking whose [start, end] lies inside one of its
    mechanic's weekly windows on that weekday (Sunday = 0).

    A mechanic's windows of a weekday are one array (the longest per start, so
    at most one per minute of the day), met by one join on (mechanic, weekday) and
    searched by a higher-order function; intervals are read once.  Input columns
    are kept.
    """
    iv = intervals if intervals is not None else booking_intervals(g)
    a = (g.mechanic_availability.groupBy("mechanic_id", "day_of_week", "start_min").agg(F.max("end_min").alias("e"))
         .groupBy(F.col("mechanic_id").alias("_am"), F.col("day_of_week").alias("_ad"))
         .agg(F.sort_array(F.collect_list(F.struct(F.col("start_min").alias("s"), "e"))).alias("_windows")))
    fits = F.exists("_windows", lambda w: (w["s"] <= F.col("start_min")) & (w["e"] >= F.col("end_min")))
    return (iv.withColumn("dow", weekday0("booking_date"))
            .join(a, (F.col("mechanic_id") == F.col("_am")) & (F.col("dow") == F.col("_ad")), "left")
            .withColumn("within_availability", F.coalesce(fits, F.lit(False))).drop("_am", "_ad", "_windows"))


def available_time_slots(g: Garage, date: Date, service_id: int | None = None,
                         duration: int | None = None, mechanic_id: int | None = None,
                         step: int = SLOT_STEP_MIN) -> DataFrame:
    """F1 (contract routine ``get_available_time_slots``): free start times on ``date``.

    Our definition: candidate starts on a ``step``-minute grid from each
    availability window's start such that [slot, slot + duration) fits in the
    window; a slot is free when no live (not cancelled) booking of that
    mechanic on that date overlaps it.  Duration = the service's estimate
    (default 60).  Slot generation is a bounded ``explode(sequence)`` per
    window; the overlap test is ``overlap_counts``.
    """
    if duration is None:
        # the service's estimate as a scalar subquery (evaluated once)
        dur = g.services.where(F.col("id") == F.lit(service_id)).select(
            F.coalesce(F.max("estimated_time"), F.lit(60))).scalar()
    else:
        dur = F.lit(int(duration))
    day = _d(date)
    a = g.mechanic_availability.where(F.col("day_of_week") == weekday0(day))
    if mechanic_id is not None:
        a = a.where(F.col("mechanic_id") == F.lit(mechanic_id))
    win = a.withColumn("duration", dur).where(F.col("end_min") - F.col("duration") >= F.col("start_min"))
    slots = win.select("mechanic_id", day.alias("booking_date"), "duration",
                       F.explode(F.sequence("start_min", F.col("end_min") - F.col("duration"), F.lit(step)))
                       .alias("slot_start"))
    slots = slots.withColumn("slot_end", F.col("slot_start") + F.col("duration")).distinct()
    busy = booking_intervals(g, g.bookings.where(F.col("booking_date") == day))
    counted = overlap_counts(slots, busy, ["mechanic_id", "booking_date"], "slot_start", "slot_end")
    return (counted.where(F.col("n_overlap") == 0)
            .select("mechanic_id", "booking_date", "slot_start", "slot_end", hhmm("slot_start").alias("slot_time")))


class _Day:
    """Current slots of one component of a date, by mechanic, each a list sorted by start."""

    def __init__(self) -> None:
        self.slots: dict[int, list[tuple]] = {}
        self.longest: dict[int, int] = {}
        self.where: dict[str, tuple[int, tuple]] = {}

    def put(self, booking: str, mechanic: int, start: int, end: int, stored: bool) -> None:
        self.take(booking)
        slot = (start, end, booking, stored)
        insort(self.slots.setdefault(mechanic, []), slot)
        self.longest[mechanic] = max(self.longest.get(mechanic, 0), end - start)
        self.where[booking] = mechanic, slot

    def take(self, booking: str) -> None:
        held = self.where.pop(booking, None)
        if held:
            own = self.slots[held[0]]
            del own[bisect_left(own, held[1])]

    def reason(self, booking: str, mechanic: int, start: int, end: int) -> str | None:
        """Why the slot can't be given: it overlaps a stored slot, or one given in this batch."""
        own, found = self.slots.get(mechanic, []), None
        for k in range(bisect_left(own, (start - self.longest.get(mechanic, 0),)), len(own)):
            s, e, other, stored = own[k]
            if s >= end:
                break
            if e > start and other != booking:
                if stored:
                    return R_CONFLICT
                found = R_BATCH_CONFLICT
        return found


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of one component at a time in order, after the stored slots of its bookings (both sorted)."""
    at, day = None, _Day()
    for batch in batches:
        roots, stored, *slots = (batch.column(c).to_pylist() for c in
                                 ("root", "stored", "booking_id", "mechanic_id", "start_min", "end_min"))
        kept, reasons = [], []
        for i, (root, held, booking, mechanic, start, end) in enumerate(zip(roots, stored, *slots)):
            if root != at:
                at, day = root, _Day()
            if held:
                day.put(booking, mechanic, start, end, True)
                continue
            reason = day.reason(booking, mechanic, start, end)
            if reason is None:
                day.put(booking, mechanic, start, end, False)
            kept.append(i)
            reasons.append(reason)
        out = batch.select(_SLOT).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(reasons, pa.string())], [*_SLOT, "reject_reason"])


_SLOT = ["booking_id", "mechanic_id", "request_seq", "booking_date", "start_min", "end_min"]


def _contested(slots: DataFrame) -> DataFrame:
    """Slots with ``island``: the start of the run of overlapping slots of their mechanic and date; ``shared`` if
    more than one booking stands in it.  The window sees at most a row per minute of the day."""
    key = ["mechanic_id", "booking_date"]
    minutes = slots.groupBy(*key, "start_min").agg(F.max("end_min").alias("reach"), F.min("booking_id").alias("lo"),
                                                   F.max("booking_id").alias("hi"))
    w = Window.partitionBy(*key).orderBy("start_min")
    before = F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    minutes = minutes.withColumn("_new", F.when(before.isNull() | (before <= F.col("start_min")), F.col("start_min")))
    minutes = minutes.withColumn("island", F.last("_new", ignorenulls=True).over(w))
    whole = Window.partitionBy(*key, "island")
    minutes = minutes.withColumn("shared", F.min("lo").over(whole) != F.max("hi").over(whole))
    return slots.join(minutes.select(*key, "start_min", "island", "shared"), [*key, "start_min"])


def assign_mechanics(g: Garage, requests: DataFrame) -> DataFrame:
    """M4: batch of (booking_id, mechanic_id, request_seq) assignment requests, applied one by one.

    Checks, in the reference's order: the booking and the mechanic exist;
    the slot lies in the mechanic's availability (J13); it overlaps no live
    booking of that mechanic on that date other than the booking itself
    (J12), as the schedule stands after all earlier requests: an accepted
    request gives the booking its new slot and frees the slot it had.

    Bookings that no request names never move, so overlaps with them are
    counted by the set-based check.  The slots that may be given or freed form, per
    mechanic and date, islands of overlapping times; a booking whose islands hold
    no other booking gets all it asks for.  The rest depends on the order, but only
    along bookings and islands: each connected component of them is replayed in
    ``request_seq`` order (ties: booking, mechanic), as a stream over sorted partitions
    whose state is that component's current slots, searched by start.  A date falls into as
    many components as it has unrelated mechanics and hours.

    Returns every request with ``reject_reason`` (NULL = accepted), the new
    booking status and the status of the mechanic's task row (its times are
    the slot's).
    """
    r = stored(requests.select("booking_id", "mechanic_id", "request_seq"))
    named = r.select(F.col("booking_id").alias("_nb")).distinct()
    # the intervals of all bookings and which of them are named, once for all that reads them
    every = booking_intervals(g, live_only=False, assigned_only=False).select(
        "id", "mechanic_id", "booking_date", "start_min", "end_min", (F.col("mechanic_id").isNotNull() & (F.col("status") != "cancelled")).alias("_live"))
    every = stored(every.join(named, F.col("id") == F.col("_nb"), "left").withColumn("_named", F.col("_nb").isNotNull()).drop("_nb"))
    live = every.where("_live").drop("_live")
    b = every.where("_named").select(F.col("id").alias("_bid"), "booking_date", "start_min", "end_min")
    mech = g.mechanics.select(F.col("id").alias("_mid")).distinct().withColumn("_m_ok", F.lit(True))
    x = (r.join(b, F.col("booking_id") == F.col("_bid"), "left")
         .join(mech, F.col("mechanic_id") == F.col("_mid"), "left"))
    # both checks keep the request columns, so they chain without joining back
    x = within_availability(g, x)
    first = (F.when(F.col("_bid").isNull(), R_NO_BOOKING).when(F.col("_m_ok").isNull(), R_NO_MECHANIC)
             .when(~F.coalesce(F.col("within_availability"), F.lit(False)), R_OUTSIDE))
    x = overlaps_by_day(x.select(*_SLOT, first.alias("_first")), live.where("not _named"), ["mechanic_id", "booking_date"])
    reason = F.coalesce("_first", F.when(F.col("n_overlap") > 0, R_CONFLICT))
    checked = stored(x.select(*_SLOT, reason.alias("reject_reason")))
    out = checked.where(F.col("reject_reason").isNotNull()).unionByName(_in_order(checked, live.where("_named")))
    ok = F.col("reject_reason").isNull()
    return out.withColumn("new_status", F.when(ok, F.lit("confirmed"))).withColumn("task_status", F.when(ok, F.lit("pending")))


def _in_order(checked: DataFrame, held: DataFrame) -> DataFrame:
    """The requests that passed the set-based checks, with the reason that the order gives; ``held``: live named bookings."""
    now = (held.where(F.col("start_min").isNotNull())
           .select(F.col("id").alias("booking_id"), "mechanic_id", F.lit(0).cast("long").alias("request_seq"),
                   "booking_date", "start_min", "end_min", F.lit(True).alias("stored")))
    open_ = checked.where(F.col("reject_reason").isNull()).select(*_SLOT, F.lit(False).alias("stored"))
    slots = stored(_contested(open_.unionByName(now)))
    ties = slots.where("shared").select(F.col("booking_id").alias("_tb")).distinct()
    slots = stored(slots.join(ties, F.col("booking_id") == F.col("_tb"), "left").withColumn("_tied", F.col("_tb").isNotNull()).drop("_tb"))
    free = slots.where("not stored and not _tied").select(*_SLOT, F.lit(None).cast("string").alias("reject_reason"))
    tied = slots.where("_tied")
    island = F.concat_ws(" ", F.lit("i"), "mechanic_id", "booking_date", "island")
    roots = components(tied.where("shared").select(F.concat(F.lit("b "), "booking_id").alias("u"), island.alias("v")))
    n = partitions_for(checked.sparkSession, tied.count())
    replay = (tied.join(roots, F.concat(F.lit("b "), "booking_id") == F.col("node"))
              .repartition(n, "root").sortWithinPartitions("root", F.col("stored").desc(), "request_seq", "booking_id", "mechanic_id")
              .select("root", "stored", *_SLOT))
    return free.unionByName(replay.mapInArrow(_replay, checked.schema))
