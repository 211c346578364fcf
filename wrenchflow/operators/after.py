"""What accepted changes do to the tables: changed and new rows per table, to be stored together.

Each function takes the tables and an applied batch (``operators.changes``,
``intervals``, ``vehicles``, ``messages``) and returns whole rows by table: rows of a
stored key replace it, others are new.  ``merged`` shows a new version without storing it;
``sources.versions.commit`` stores all tables of a batch under one version.

New keys (bookings, payments, tasks, notes, users) are numbered once by
``number_rows``, which stores the numbered rows (checkpoint); parents and children are
read from those, so a lost executor can't give them different keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.functions.predicates import Date, _d
from wrenchflow.operators.changes import customer_counter_after, number_rows
from wrenchflow.session import stored
from wrenchflow.sources.tables import Garage, conform
from wrenchflow.sources.versions import key_of


class Later(Mapping[str, DataFrame]):
    """Frames by table; one given as a function is made when it is first asked for, once."""

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._frames = dict(frames)

    def __getitem__(self, table: str) -> DataFrame:
        if not isinstance(self._frames[table], DataFrame):
            self._frames[table] = self._frames[table]()
        return self._frames[table]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)


class Changes(Later):
    """Changed and new rows by table; ``whole`` has the new version of tables of which rows only get new values or that only
    get new keys, made by one join or none instead of two (the changed rows, and the others without them)."""

    def __init__(self, rows: Mapping[str, DataFrame | Callable[[], DataFrame]], **whole: DataFrame | Callable[[], DataFrame]):
        super().__init__(rows)
        self.whole = Later(whole)


class _Merged(Garage):
    """Tables with changes, each put together when it is asked for, so a stored table that nobody reads is not opened."""

    def __init__(self, g: Garage, changes: Mapping[str, DataFrame]):
        self._g, self._changes = g, changes

    def __getattribute__(self, name: str):
        if name not in Garage.__dataclass_fields__:
            return object.__getattribute__(self, name)
        g, changes = self._g, self._changes
        whole = getattr(changes, "whole", {})
        if name in whole:
            return whole[name]
        old = getattr(g, name)
        if name not in changes:
            return old
        key, rows = key_of(name), changes[name]
        return old.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*old.columns))


def merged(g: Garage, changes: Mapping[str, DataFrame]) -> Garage:
    """The tables with the changes, unstored; tables without a change stay as they are."""
    return _Merged(g, changes)


def _accepted(applied: DataFrame) -> DataFrame:
    return applied.where(F.col("reject_reason").isNull())


def _next_id(table: DataFrame) -> Column:
    return F.coalesce(table.select(F.max("id")).scalar(), F.lit(0).cast("long"))


def _last(rows: DataFrame, key: str, order: Column, **values: Column) -> DataFrame:
    """Per key the values of its last row; one aggregate, combined before the shuffle."""
    best = rows.groupBy(F.col(key).alias("_key")).agg(
        F.max(F.struct(order.alias("_o"), *[v.alias(k) for k, v in values.items()])).alias("_b"))
    return best.select("_key", *[F.col(f"_b.{k}").alias(f"_{k}") for k in values])


def _updated(table: DataFrame, last: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``table`` with a key in ``last``, with some columns set."""
    return table.join(last, F.col("id") == F.col("_key")).select(
        *[columns[c].cast(table.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in table.columns])


def _with_updates(table: DataFrame, last: DataFrame, **columns: Column) -> DataFrame:
    """All rows of ``table``, those with a key in ``last`` (where it is unique) with some columns set."""
    met = F.col("_key").isNotNull()
    return table.join(last, F.col("id") == F.col("_key"), "left").select(
        *[F.when(met, columns[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
          for c in table.columns])


def after_new_bookings(g: Garage, applied: DataFrame, as_of: Date) -> Changes:
    """M1: new bookings, a pending payment for those with a payment method, vehicles with a new owner, counters."""
    new = _accepted(applied)
    booked = conform(new, "bookings")

    @cache
    def payments() -> DataFrame:
        paid = number_rows(new.where("payment_method is not null").select(
            F.col("id").alias("booking_id"), "payment_method", "is_down_payment", "down_payment_percent", "down_payment_amount",
            "payment_status"), ["booking_id"], start=_next_id(g.payments), out="id")
        return conform(paid.withColumn("payment_date", _d(as_of).cast("timestamp_ntz")), "payments")
    owner = _last(applied.where("vehicle_owner_after is not null"), "vehicle_id", F.struct("request_seq", "customer_id"),
                  owner=F.col("vehicle_owner_after"))
    vehicles = _updated(g.vehicles, owner, customer_id=F.col("_owner"))
    before = g.vehicles.select(F.col("id").alias("_vid"), F.col("customer_id").alias("_was"))
    vehicles = (vehicles.join(before, F.col("id") == F.col("_vid")).where(~F.col("customer_id").eqNullSafe(F.col("_was")))
                .select(*g.vehicles.columns))
    by = new.select(F.col("customer_id").alias("_b")).distinct()
    counters = customer_counter_after(g, new).join(by, F.col("id") == F.col("_b"), "left_semi")
    more = new.groupBy(F.col("customer_id").alias("_key")).agg(F.count("*").alias("_more"))
    counted = F.coalesce(F.col("total_bookings"), F.lit(0)) + F.col("_more")
    return Changes({"bookings": booked, "payments": payments, "vehicles": vehicles, "customers": conform(counters, "customers")},
                   bookings=g.bookings.unionByName(booked), payments=lambda: g.payments.unionByName(payments()),
                   vehicles=_with_updates(g.vehicles, owner, customer_id=F.col("_owner")),
                   customers=_with_updates(g.customers, more, total_bookings=counted))


def after_cancellations(g: Garage, applied: DataFrame) -> Changes:
    """M3: cancelled bookings."""
    gone = _accepted(applied).select(F.col("booking_id").alias("_key")).distinct()
    return {"bookings": _updated(g.bookings, gone, status=F.lit("cancelled"))}


def after_assignments(g: Garage, applied: DataFrame) -> Changes:
    """M4: bookings confirmed with the mechanic of their last accepted request, and a task per accepted request."""
    # evaluated once, by the numbering, which stores it; the mechanics are read from there
    tasks = number_rows(_accepted(applied).select("request_seq", "booking_id", "mechanic_id", F.col("task_status").alias("status"),
                                                  "start_min", "end_min"),
                        ["request_seq", "booking_id", "mechanic_id"], start=_next_id(g.mechanic_tasks), out="id")
    last = _last(tasks, "booking_id", F.struct("request_seq", "mechanic_id"), mechanic=F.col("mechanic_id"))
    set_ = {"mechanic_id": F.col("_mechanic"), "status": F.lit("confirmed")}
    new = conform(tasks, "mechanic_tasks")
    return Changes({"bookings": _updated(g.bookings, last, **set_), "mechanic_tasks": new},
                   bookings=_with_updates(g.bookings, last, **set_), mechanic_tasks=g.mechanic_tasks.unionByName(new))


def after_task_status(g: Garage, applied: DataFrame) -> Changes:
    """M5: tasks with the times and status of their last change (new ones get an id), bookings that mirror them.

    A completion's time falls on the booking's date.
    """
    ok = stored(_accepted(applied).select("task_key", "change_no", "status", "start_min", "end_min", "task_id", "booking_id", "mechanic_id",
                                          "booking_status", "completed_min"))
    last = _last(ok, "task_key", F.col("change_no"), status=F.col("status"), start=F.col("start_min"), end=F.col("end_min"),
                 task=F.col("task_id"), booking=F.col("booking_id"), mechanic=F.col("mechanic_id"))
    last = stored(last)
    held = last.where("_task is not null").withColumn("_key", F.col("_task")).select("_key", "_status", "_start", "_end")
    times = {"status": F.col("_status"), "start_min": F.col("_start"), "end_min": F.col("_end")}
    fresh = number_rows(last.where("_task is null").select(
        F.col("_booking").alias("booking_id"), F.col("_mechanic").alias("mechanic_id"), F.col("_status").alias("status"),
        F.col("_start").alias("start_min"), F.col("_end").alias("end_min")), ["booking_id", "mechanic_id"],
        start=_next_id(g.mechanic_tasks), out="id")
    shown = _last(ok.where("booking_status is not null"), "booking_id", F.col("change_no"), status=F.col("booking_status"))
    done = _last(ok.where("completed_min is not null"), "booking_id", F.col("change_no"), at=F.col("completed_min"))
    marks = shown.join(done, "_key", "left")
    stamp = F.timestamp_add("MINUTE", F.col("_at"), F.col("booking_date").cast("timestamp_ntz"))
    set_ = {"status": F.col("_status"), "completed_at": F.coalesce(stamp, F.col("completed_at"))}
    fresh = conform(fresh, "mechanic_tasks")
    return Changes({"mechanic_tasks": _updated(g.mechanic_tasks, held, **times).unionByName(fresh), "bookings": _updated(g.bookings, marks, **set_)},
                   mechanic_tasks=_with_updates(g.mechanic_tasks, held, **times).unionByName(fresh),
                   bookings=_with_updates(g.bookings, marks, **set_))


def after_payment_decisions(g: Garage, applied: DataFrame) -> Changes:
    """M6: payments with their last decision; bookings of every approved one are confirmed."""
    ok = _accepted(applied)
    last = _last(ok, "payment_id", F.struct("decision_seq", "decision", "admin_notes"), status=F.col("new_payment_status"), notes=F.col("admin_notes"))
    confirmed = ok.where("booking_status is not null").select(F.col("booking_id").alias("_key")).distinct()
    paid, booked = {"payment_status": F.col("_status"), "admin_notes": F.col("_notes")}, {"status": F.lit("confirmed")}
    return Changes({"payments": _updated(g.payments, last, **paid), "bookings": _updated(g.bookings, confirmed, **booked)},
                   payments=_with_updates(g.payments, last, **paid), bookings=_with_updates(g.bookings, confirmed, **booked))


def after_moderation(g: Garage, applied: DataFrame) -> Changes:
    """M8: testimonials in the state after their last accepted action."""
    last = _last(_accepted(applied), "testimonial_id", F.col("action_seq"), approved=F.col("approved_after"), featured=F.col("featured_after"))
    shown = {"approved": F.col("_approved"), "featured": F.col("_featured")}
    return Changes({"testimonials": _updated(g.testimonials, last, **shown)}, testimonials=_with_updates(g.testimonials, last, **shown))


def after_field_notes(g: Garage, applied: DataFrame) -> Changes:
    """New notes, and the newest accepted one copied into its booking."""
    ok = _accepted(applied)

    @cache
    def notes() -> DataFrame:
        return conform(number_rows(ok.select("note_seq", "booking_id", "mechanic_id", "note", "date", "status"), ["note_seq", "booking_id"],
                                   start=_next_id(g.field_notes), out="id"), "field_notes")
    newest = ok.groupBy(F.col("booking_id").alias("_key")).agg(F.max("booking_note_after").alias("_note"))  # the same in all its rows
    return Changes({"field_notes": notes, "bookings": _updated(g.bookings, newest, notes=F.col("_note"))},
                   field_notes=lambda: g.field_notes.unionByName(notes()), bookings=_with_updates(g.bookings, newest, notes=F.col("_note")))


def after_provisioning(g: Garage, applied: DataFrame) -> Changes:
    """New users, and a customer or mechanic row for those of that role, all under the user ids given once."""
    ok = _accepted(applied).withColumn("id", F.col("user_id")).withColumn("status", F.lit("active"))
    customers = number_rows(ok.where("role = 'customer'").select("user_id", "address", F.lit(0).cast("long").alias("total_bookings")),
                            ["user_id"], start=_next_id(g.customers), out="id")
    mechanics = number_rows(ok.where("role = 'mechanic'").select("user_id", "specialization", "experience"), ["user_id"],
                            start=_next_id(g.mechanics), out="id")
    return {"users": conform(ok, "users"), "customers": conform(customers, "customers"), "mechanics": conform(mechanics, "mechanics")}
