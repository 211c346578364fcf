"""Batch state changes (M1-M3, M5-M17), re-aimed from per-request writes.

Each operator takes a *change set* DataFrame and returns it with a
``reject_reason`` column (NULL = accepted) plus the values the change
produces.  Parquet has no MERGE, so a new table version is
``old LEFT ANTI changed-keys UNION changed rows`` (``merge_snapshot``),
written as a new snapshot by the caller.

Sequential semantics inside one batch (two changes to one row) are kept
without gathering a key's changes in one place: "last change wins" is a
``max_by`` aggregate (partial, map-side), "first accepted wins" is a
``min`` aggregate, and "state at the time of each change" (moderation) is
``segmented_last`` -- a range-partitioned scan with per-partition carries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchflow.functions.exprs import coerce_bool, initials, parse_hhmm
from wrenchflow.functions.predicates import Date, _d
from wrenchflow.model import BOOKING_STATUSES, TASK_STATUSES, USER_ROLES
from wrenchflow.operators.ordered import Running, carried, dealt, hot_keys, joined_by, running, within_tasks
from wrenchflow.session import partitions_for, stored
from wrenchflow.sources.tables import Garage

# --- fixed values: reject messages of the reference ----------------------
R_REQUIRED_BOOKING = "Service, vehicle, date and time are required"
R_SERVICE_NOT_FOUND = "Service not found"
R_SERVICE_UNAVAILABLE = "Service is currently unavailable"
R_VEHICLE_NOT_FOUND = "Vehicle not found"
R_VEHICLE_NOT_OWNED = "Vehicle does not belong to this customer"
R_CUSTOMER_REQUIRED = "Customer ID is required for admin/staff booking creation"
R_NOT_AUTHORIZED_CREATE = "Not authorized to create bookings"
R_BOOKING_NOT_FOUND = "Booking not found"
R_STATUS_REQUIRED = "Valid status is required"
R_MECHANIC_NOT_ASSIGNED = "Not authorized to update this booking"
R_MECHANIC_STATUS = "Valid status is required. Mechanics can only set in-progress or completed status."
R_NOT_AUTHORIZED_STATUS = "Not authorized to update booking status"
R_CANCEL_NOT_OWNED = "Booking not found or not owned by you"
R_CANCEL_STATE = "Only pending or confirmed bookings can be cancelled"
R_TASK_STATUS = "Valid status is required (pending, in-progress, completed)"
R_TASK_NOT_FOUND = "Task or booking not found or not assigned to you"
R_PAYMENT_NOT_FOUND = "Payment not found"
R_TESTIMONIAL_REQUIRED = "Service ID, rating, and comment are required"
R_RATING_RANGE = "Rating must be between 1 and 5"
R_MECHANIC_NOT_FOUND = "Mechanic not found"
R_ALREADY_REVIEWED = "You have already submitted a testimonial for this service/mechanic combination"
R_TESTIMONIAL_NOT_FOUND = "Testimonial not found"
R_FEATURE_UNAPPROVED = "Cannot feature an unapproved testimonial"
R_SCHEDULE_NOT_FOUND = "Booking schedule not found"
R_VEHICLE_IN_USE = "Cannot delete vehicle that is used in bookings"
R_NOTE_REQUIRED = "Booking ID and note are required"
R_NOTE_NOT_ASSIGNED = "Booking not found or not assigned to you"
R_USER_REQUIRED = "All fields are required"
R_USER_ROLE = "Invalid role specified"
R_EMAIL_IN_USE = "Email already in use"
R_MECHANIC_FIELDS = "Specialization and experience are required for mechanics"
R_INCOMPLETE_SLOT = "Each availability slot needs a day, start and end time"
AUDIT_CANCEL = "cancel_booking"
# ---------------------------------------------------------------------------


def merge_snapshot(old: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """New table version: old rows without a change, plus the changed rows."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed.select(*old.columns))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The message of the first failing check (CASE WHEN chain), NULL when all pass."""
    expr = None
    for failed, msg in checks:
        cond = F.coalesce(failed, F.lit(False))
        expr = F.when(cond, F.lit(msg)) if expr is None else expr.when(cond, F.lit(msg))
    return expr


def is_falsy(c: Column) -> Column:
    """JavaScript falsiness of a request field: NULL, '' or 0."""
    return c.isNull() | (c.cast("string") == "") | (c.cast("string") == "0")


# --- M14 -----------------------------------------------------------------

def number_rows(df: DataFrame, order: list[str], start: Column | int = 0, out: str = "row_no",
                partitions: int | None = None, fixed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Dense 1-based numbering in ``order`` plus ``start``, without a global window.

    Rows are range-partitioned and sorted on ``order``; inside a partition
    ``monotonically_increasing_id`` carries the row index in its low bits;
    each partition's offset is a running sum over the per-partition counts
    (one row per partition, so the table is bounded by the partition count
    and safe to broadcast).  The rows are evaluated once and stored (``fixed``: they are read from stored ones
    already), their number gives that of the partitions, and the numbered ones, of which only ``keep`` is needed
    further, are stored so that the numbers stay fixed.
    """
    held = df if fixed else stored(df)
    n = partitions or partitions_for(df.sparkSession, held.count())
    ranged = held.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(keep or df.columns))
    tagged = stored(ranged.withColumn("_mid", F.monotonically_increasing_id()), instead_of=() if fixed else (held,))
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).select("_pid", "_off")
    base = start if isinstance(start, Column) else F.lit(start)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, base + F.col("_off") + F.col("_idx") + 1)
            .drop("_mid", "_pid", "_idx", "_off"))


def assign_booking_ids(new: DataFrame, existing: DataFrame, order: list[str], **how) -> DataFrame:
    """``B-<n>`` keys continuing after the largest existing number; ``how``: see ``number_rows``."""
    # scalar subquery: the largest existing number, evaluated once
    top = existing.select(F.max(F.regexp_extract("id", r"^B-(\d+)$", 1).try_cast("long"))).scalar()
    numbered = number_rows(new, order, **how)
    return (numbered.withColumn("id", F.concat(F.lit("B-"), (F.coalesce(top, F.lit(0)) + F.col("row_no"))
                                               .cast("string")))
            .drop("row_no"))


# --- M1 -------------------------------------------------------------------

def apply_new_bookings(g: Garage, requests: DataFrame) -> DataFrame:
    """M1: create bookings from requests.

    Request columns: request_seq, role, requester_customer_id, customer_id,
    service_id, vehicle_id, booking_date, booking_time (HH:MM text), notes,
    mechanic_id, customer_name, payment_method, is_down_payment,
    down_payment_percent, down_payment_amount.

    Checks in the reference's order; a customer adopts an unowned vehicle
    (the first such request that passes the earlier checks wins it; later
    requests by others are rejected as not owned); admin/staff reassign, and
    later requests see the new owner.  Accepted rows get a
    new ``B-<n>`` id (M14), status pending and a pending payment row whose
    percent/amount are 0 unless it is a down payment.  Requests of one
    ``request_seq`` follow each other by vehicle and customer.
    """
    is_cust, is_staff = F.col("role") == "customer", F.col("role").isin("admin", "staff")
    eff_customer = F.when(is_cust, F.col("requester_customer_id")).when(is_staff, F.col("customer_id"))
    required = (is_falsy(F.col("service_id")) | is_falsy(F.col("vehicle_id")) | is_falsy(F.col("booking_date"))
                | is_falsy(F.col("booking_time")))
    kind = F.when(is_cust, 1).when(is_staff, 2).when(F.col("role").isNotNull(), 0).cast("byte")
    down = coerce_bool(F.col("is_down_payment"))
    # whole requests are kept under a mark, as they will be shown; all checks move only their keys, and the outcome joins the requests in the end
    whole = stored(requests.select(
        F.monotonically_increasing_id().alias("_req"), "request_seq", eff_customer.alias("_cust"), kind.alias("_kind"), required.alias("_required"),
        "service_id", "vehicle_id", F.col("booking_date").cast("date").alias("booking_date"), parse_hhmm(F.col("booking_time")).alias("start_min"),
        "notes", "mechanic_id", "customer_name", "payment_method", down.alias("is_down_payment"),
        F.when(down, F.col("down_payment_percent")).otherwise(F.lit(0)).cast("int").alias("down_payment_percent"),
        F.when(down, F.col("down_payment_amount")).otherwise(F.lit(0)).cast("decimal(12,2)").alias("down_payment_amount")))
    svc = g.services.select(F.col("id").alias("_sid"), F.col("in_stock").alias("_in_stock"),
                            F.col("price").alias("_price"))
    veh = g.vehicles.select(F.col("id").alias("_vid"), F.col("customer_id").alias("_owner"))
    cust, staff = F.col("_kind") == 1, F.col("_kind") == 2
    r = (whole.select("_req", "request_seq", "_cust", "_kind", "service_id", "vehicle_id", "_required")
         .join(svc, F.col("service_id") == F.col("_sid"), "left"))
    # messages move as their numbers
    reasons = [R_REQUIRED_BOOKING, R_SERVICE_NOT_FOUND, R_SERVICE_UNAVAILABLE, R_NOT_AUTHORIZED_CREATE, R_CUSTOMER_REQUIRED, R_VEHICLE_NOT_FOUND,
               R_VEHICLE_NOT_OWNED]
    told = first_reason(*[(F.col("_why") == i, message) for i, message in enumerate(reasons, 1)])
    # a request takes part in ownership once it passes every check that comes before it
    takes_part = (~F.coalesce("_required", F.lit(False)) & F.col("_sid").isNotNull() & F.coalesce("_in_stock", F.lit(False))
                  & (cust | (staff & ~is_falsy(F.col("_cust")))))
    r = stored(r.select("_req", "request_seq", "_cust", "_kind", "vehicle_id", "_price", takes_part.alias("_part"),
                        first_reason((F.col("_required"), 1), (F.col("_sid").isNull(), 2), (~F.col("_in_stock"), 3), (~cust & ~staff, 4),
                                     (staff & is_falsy(F.col("_cust")), 5)).cast("byte").alias("_why")))
    # the owner before each request: the customer of the last staff request (they reassign), else the first
    # customer request of an unowned vehicle (it adopts); a scan by vehicle, which moves there once, for its owner and for this
    part = F.col("_part") & F.col("_vid").isNotNull()
    wanted = {"_staff_owner": Running(F.when(part & staff, F.col("_cust")), last=True, inclusive=False),
              "_adopter": Running(F.when(part & cust, F.col("_cust")), inclusive=False)}
    order = ["request_seq", "_cust", "_req"]
    n, hot, met = partitions_for(r.sparkSession, r.count()), hot_keys(r, "vehicle_id"), F.col("vehicle_id") == F.col("_hk")
    named = r.where("vehicle_id is not null")
    crowded = not hot.isEmpty()
    few = named.join(F.broadcast(hot), met, "left_anti") if crowded else named
    seen = [within_tasks(few.repartition(n, "vehicle_id").join(veh, F.col("vehicle_id") == F.col("_vid"), "left"), "vehicle_id", order, wanted)
            .drop("_alone")]
    if crowded:  # vehicles of more requests than a task should have: dealt by their order, what came before is carried
        many = dealt(named.join(F.broadcast(hot), met, "left_semi"), "vehicle_id", order).join(veh, F.col("vehicle_id") == F.col("_vid"), "left")
        seen.append(running(many, "vehicle_id", order, wanted).drop("_p"))
    if not (unnamed := r.where("vehicle_id is null")).isEmpty():  # nobody owns no vehicle
        nobody = F.lit(None).cast(g.vehicles.schema["customer_id"].dataType)
        seen.append(unnamed.withColumn("_vid", F.lit(None).cast(g.vehicles.schema["id"].dataType)).withColumn("_owner", nobody)
                    .withColumn("_staff_owner", F.lit(None).cast(r.schema["_cust"].dataType))
                    .withColumn("_adopter", F.lit(None).cast(r.schema["_cust"].dataType)))
    owner_now = F.coalesce(F.col("_staff_owner"), F.col("_owner"), F.col("_adopter"), F.when(part, F.col("_cust")))
    not_owned = F.coalesce(cust & (owner_now != F.col("_cust")), F.lit(False))
    fate = stored(reduce(DataFrame.unionByName, seen).select(
        F.col("_req").alias("_of"), "request_seq", "vehicle_id", "_cust", "_price",
        F.when(F.col("_vid").isNotNull(), F.when(staff & part, F.col("_cust")).otherwise(owner_now)).alias("vehicle_owner_after"),
        F.coalesce("_why", first_reason((F.col("_vid").isNull(), 6), (not_owned, 7)).cast("byte")).alias("_why")), instead_of=(r,))
    found = ["_of", "_price", "vehicle_owner_after", "_why"]
    accepted = assign_booking_ids(fate.where("_why is null"), g.bookings, ["request_seq", "vehicle_id", "_cust", "_of"], fixed=True, keep=found)
    rejected = fate.where("_why is not null").select(*found, F.lit(None).cast("string").alias("id"))
    fate = accepted.unionByName(rejected).withColumn("reject_reason", told)
    ok = F.col("reject_reason").isNull()
    return joined_by(whole.drop("_kind", "_required"), "_req", fate.drop("_why"), "_of").select(
        "request_seq", F.col("_cust").alias("customer_id"), "service_id", "vehicle_id", "booking_date", "start_min", "notes", "mechanic_id",
        "customer_name", F.col("_price").alias("total_price"), "payment_method", "is_down_payment", "down_payment_percent", "down_payment_amount",
        "vehicle_owner_after", "reject_reason", "id", F.when(ok, F.lit("pending")).alias("status"),
        F.when(ok & F.col("payment_method").isNotNull(), F.lit("pending")).alias("payment_status"))


def customer_counter_after(g: Garage, accepted: DataFrame) -> DataFrame:
    """M1 side effect: ``total_bookings`` + accepted new bookings per customer."""
    inc = accepted.groupBy(F.col("customer_id").alias("_c")).agg(F.count("*").alias("_inc"))
    return (g.customers.join(inc, F.col("id") == F.col("_c"), "left")
            .withColumn("total_bookings", F.coalesce("total_bookings", F.lit(0)) + F.coalesce("_inc", F.lit(0)))
            .drop("_c", "_inc"))


# --- M2 / M3 -------------------------------------------------------------------

def apply_status_changes(g: Garage, changes: DataFrame, as_of_ts: str) -> DataFrame:
    """M2: (change_seq, booking_id, new_status, actor_role, actor_mechanic_id).

    admin/staff may set any of the five statuses; a mechanic only on its own
    bookings and only in-progress / completed; others are refused.  Setting
    completed stamps ``completed_at``, which later changes keep.  ``is_final``
    marks the last accepted change per booking (a ``max`` aggregate), whose
    status the new version carries; it shows the stamp of any accepted
    completion of its booking in the batch.
    """
    b = g.bookings.select(F.col("id").alias("_bid"), F.col("mechanic_id").alias("_bm"),
                          F.col("status").alias("old_status"))
    c = changes.join(b, F.col("booking_id") == F.col("_bid"), "left")
    role, st = F.col("actor_role"), F.col("new_status")
    reason = first_reason(
        (F.col("_bid").isNull(), R_BOOKING_NOT_FOUND),
        (role.isin("admin", "staff") & ~F.coalesce(st.isin(*BOOKING_STATUSES), F.lit(False)), R_STATUS_REQUIRED),
        ((role == "mechanic") & ~F.col("_bm").eqNullSafe(F.col("actor_mechanic_id")), R_MECHANIC_NOT_ASSIGNED),
        ((role == "mechanic") & ~F.coalesce(st.isin("in-progress", "completed"), F.lit(False)), R_MECHANIC_STATUS),
        (~role.isin("admin", "staff", "mechanic") | role.isNull(), R_NOT_AUTHORIZED_STATUS),
    )
    out = c.withColumn("reject_reason", reason).withColumn(
        "completed_at", F.when(F.col("reject_reason").isNull() & (st == "completed"),
                               F.lit(as_of_ts).cast("timestamp_ntz")))
    # of several changes of one number the last by status, role and mechanic
    place = F.struct("change_seq", "new_status", "actor_role", "actor_mechanic_id")
    last = (out.where(F.col("reject_reason").isNull()).groupBy(F.col("booking_id").alias("_lb"))
            .agg(F.max(place).alias("_last"), F.max("completed_at").alias("_done_at")))
    return (out.join(last, (F.col("booking_id") == F.col("_lb")) & place.eqNullSafe(F.col("_last")), "left")
            .withColumn("is_final", F.col("_last").isNotNull())
            .withColumn("completed_at", F.coalesce("completed_at", "_done_at"))
            .select("change_seq", "booking_id", "actor_role", "actor_mechanic_id", "old_status", "new_status",
                    "reject_reason", "completed_at", "is_final"))


def bookings_after_status_changes(g: Garage, applied: DataFrame) -> DataFrame:
    """New bookings version from M2's final accepted changes."""
    fin = applied.where(F.col("is_final")).groupBy(F.col("booking_id").alias("_fb")).agg(
        F.max("new_status").alias("new_status"), F.max("completed_at").alias("_ca"))  # one status; repeated rows are alike
    changed = (g.bookings.join(fin, F.col("id") == F.col("_fb"))
               .withColumn("status", F.col("new_status"))
               .withColumn("completed_at", F.coalesce("_ca", "completed_at")).drop("_fb", "new_status", "_ca"))
    return merge_snapshot(g.bookings, changed, "id")


def apply_cancellations(g: Garage, requests: DataFrame) -> DataFrame:
    """M3: (request_seq, booking_id, customer_id, user_id): a customer cancels its own
    pending / confirmed booking; each accepted one yields an audit row (E13).

    A second request for an already-cancelled booking in the same batch is
    refused like the reference's second call (the first accepted one wins,
    a ``min`` aggregate); rows of one ``request_seq`` follow each other.
    """
    b = g.bookings.select(F.col("id").alias("_bid"), F.col("customer_id").alias("_bc"),
                          F.col("status").alias("old_status"))
    requests = number_rows(requests, ["request_seq", "booking_id", "customer_id", "user_id"], out="_row")
    c = requests.join(b, (F.col("booking_id") == F.col("_bid")) & (F.col("customer_id") == F.col("_bc")), "left")
    base = first_reason((F.col("_bid").isNull(), R_CANCEL_NOT_OWNED),
                         (~F.col("old_status").isin("pending", "confirmed"), R_CANCEL_STATE))
    c = c.withColumn("_r", base)
    first = (c.where(F.col("_r").isNull()).groupBy(F.col("booking_id").alias("_fb"))
             .agg(F.min("_row").alias("_first")))
    c = c.join(first, F.col("booking_id") == F.col("_fb"), "left")
    reason = F.coalesce(F.col("_r"), F.when(F.col("_row") != F.col("_first"), F.lit(R_CANCEL_STATE)))
    ok = reason.isNull()
    return c.select(
        "request_seq", "booking_id", "customer_id", "user_id", "old_status", reason.alias("reject_reason"),
        F.when(ok, F.lit(AUDIT_CANCEL)).alias("audit_action"),
        F.when(ok, F.lit("bookings")).alias("audit_table"),
        F.when(ok, F.to_json(F.struct(F.col("old_status").alias("status")))).alias("old_values"),
        F.when(ok, F.to_json(F.struct(F.lit("cancelled").alias("status")))).alias("new_values"))


# --- M5 -------------------------------------------------------------------------

def apply_task_status(g: Garage, changes: DataFrame) -> DataFrame:
    """M5: (change_seq, ref, mechanic_id, status, now_min).

    ``ref`` names a booking assigned to the mechanic (its task is used, or
    created once, by its first accepted change, with start = now and end = the
    booking's start) or a task id
    whose booking is assigned to the mechanic.  in-progress sets the start
    when unset (or equal to the end); completed sets the end when unset.
    in-progress / completed are mirrored to the booking, completed with its time.
    Later changes of the batch see what earlier ones have set (by ``change_seq``, then
    ``ref``; ``change_no`` numbers all rows in that order, ``task_key`` names the task or,
    before it has an id, its booking and mechanic).
    Resolution is two equi-joins (booking id, task id), never an OR join.
    """
    b = g.bookings.select(F.col("id").alias("_bid"), F.col("mechanic_id").alias("_bm"),
                          F.col("start_min").alias("_bstart"))
    t = g.mechanic_tasks.select(F.col("id").alias("_tid"), F.col("booking_id").alias("_tb"),
                                F.col("mechanic_id").alias("_tm"), F.col("start_min").alias("_ts"),
                                F.col("end_min").alias("_te"))
    # all three joins by (ref, mechanic_id), so the changes move once; a booking that is found is the one of that ref
    c = changes.join(b, (F.col("ref") == F.col("_bid")) & (F.col("mechanic_id") == F.col("_bm")), "left")
    c = c.join(t, (F.col("ref") == F.col("_tb")) & (F.col("mechanic_id") == F.col("_tm")) & F.col("_bid").isNotNull(), "left")
    by_task = t.join(g.bookings.select(F.col("id").alias("_b2"), F.col("mechanic_id").alias("_bm2")),
                     F.col("_tb") == F.col("_b2")).select(
        F.col("_tid").alias("_xt"), F.col("_tb").alias("_xb"), F.col("_bm2").alias("_xbm"),
        F.col("_ts").alias("_xs"), F.col("_te").alias("_xe"))
    c = c.join(by_task, F.col("_bid").isNull() & (F.col("ref") == F.col("_xt").cast("string"))
               & (F.col("mechanic_id") == F.col("_xbm")), "left")
    found_booking, found_task = F.col("_bid").isNotNull(), F.col("_xt").isNotNull()
    reason = first_reason((~F.coalesce(F.col("status").isin(*TASK_STATUSES), F.lit(False)), R_TASK_STATUS),
                           (~found_booking & ~found_task, R_TASK_NOT_FOUND))
    task_id = F.when(found_booking, F.col("_tid")).otherwise(F.col("_xt"))
    booking_id = F.when(found_booking, F.col("_bid")).otherwise(F.col("_xb"))
    new = found_booking & F.col("_tid").isNull()
    out = c.select("change_seq", "ref", "mechanic_id", "status", "now_min", reason.alias("reject_reason"),
                   task_id.alias("task_id"), booking_id.alias("booking_id"), new.alias("new"),
                   F.when(found_booking, F.col("_ts")).otherwise(F.col("_xs")).alias("start_min"),
                   F.when(new, F.col("_bstart")).when(found_booking, F.col("_te")).otherwise(F.col("_xe")).alias("end_min"))
    # rows of one change_seq follow each other by ref; a number of their own keeps repeated ones apart
    out = number_rows(out, ["change_seq", "ref", "mechanic_id", "now_min"], out="_row")
    st, done = F.col("status"), F.col("reject_reason").isNull()
    # changes of one task, or of the booking that gets one; refused ones change nothing
    key = F.when(done, F.coalesce(F.col("task_id").cast("string"), F.concat_ws(" ", "booking_id", F.col("mechanic_id").cast("string"))))
    out = _task_times(out.withColumn("_task", key))
    return out.select("change_seq", "ref", "mechanic_id", "status", "reject_reason",
                      F.when(done, F.col("task_id")).alias("task_id"), F.when(done, F.col("booking_id")).alias("booking_id"),
                      F.when(done, F.col("new") & (F.col("_row") == F.col("_first"))).alias("task_created"),
                      F.when(done, F.col("_start")).alias("start_min"), F.when(done, F.col("_end")).alias("end_min"),
                      F.when(done & st.isin("in-progress", "completed"), st).alias("booking_status"),
                      F.when(done & (st == "completed"), F.col("now_min")).alias("completed_min"),
                      F.col("_row").alias("change_no"), F.col("_task").alias("task_key"))


def _task_times(changes: DataFrame) -> DataFrame:
    """``changes`` with ``_start`` and ``_end`` of their task after each of them, and ``_first``, the task's first row.

    The end is set once: to the stored one, else to the time of the first completion.  While it is
    open, the start is the stored one or the first time of going in progress.  Once it is known, a start that is
    missing or equal to the end gives way to the first later time of going in progress that differs from the end
    (a missing one meanwhile to the end).  So every state is the first of something up to a row, and two carried
    scans give it, however many changes a task has.
    """
    order = ["_row"]
    begun, ended = F.col("status") == "in-progress", F.col("status") == "completed"
    before = F.coalesce(F.col("end_min"), F.col("_done_before"))
    first = {"_first": Running(F.col("_row")), "_first_now": Running(F.col("now_min")),
             "_done": Running(F.when(ended, F.col("now_min"))),
             "_done_before": Running(F.when(ended, F.col("now_min")), inclusive=False)}
    then = {"_open": Running(F.when(begun & before.isNull(), F.col("now_min"))),
            "_moved": Running(F.when(begun & (F.col("now_min") != before), F.col("now_min"))),
            "_met": Running(F.when(begun & (F.col("now_min") == before), F.col("now_min")))}

    def scans(rows: DataFrame, scan: Callable) -> DataFrame:
        rows = scan(rows, "_task", order, first)
        return scan(rows.withColumn("_end", F.coalesce("end_min", "_done")), "_task", order, then)

    rows = carried(changes, "_task", order, scans)
    start0 = F.when(F.col("new"), F.col("_first_now")).otherwise(F.col("start_min"))
    start = F.coalesce(start0, F.col("_open"))
    settled = F.col("_end").isNull() | (start != F.col("_end"))
    return rows.withColumn("_start", F.when(F.coalesce(settled, F.lit(False)), start)
                           .otherwise(F.coalesce("_moved", start, F.col("_met"))))


# --- M6 --------------------------------------------------------------------------

def apply_payment_decisions(g: Garage, decisions: DataFrame) -> DataFrame:
    """M6: (decision_seq, payment_id, decision approve|reject, admin_notes).

    approve -> payment approved and its booking confirmed; reject -> payment
    rejected; notes default ''.  The last decision per payment is final.
    """
    p = g.payments.select(F.col("id").alias("_pid"), F.col("booking_id").alias("_pb"),
                          F.col("payment_status").alias("old_status"))
    d = decisions.join(p, F.col("payment_id") == F.col("_pid"), "left")
    reason = first_reason((F.col("_pid").isNull(), R_PAYMENT_NOT_FOUND),
                           (~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)),
                            "Unknown decision"))
    ok = reason.isNull()
    new = F.when(F.col("decision") == "approve", "approved").otherwise("rejected")
    out = d.select("decision_seq", "payment_id", F.col("_pb").alias("booking_id"), "old_status", "decision",
                   reason.alias("reject_reason"), F.when(ok, new).alias("new_payment_status"),
                   F.when(ok, F.coalesce(F.col("admin_notes"), F.lit(""))).alias("admin_notes"),
                   F.when(ok & (F.col("decision") == "approve"), F.lit("confirmed")).alias("booking_status"))
    place = F.struct("decision_seq", "decision", "admin_notes")  # of several decisions of one number the last by these
    last = (out.where(F.col("reject_reason").isNull()).groupBy(F.col("payment_id").alias("_lp"))
            .agg(F.max(place).alias("_last")))
    return (out.join(last, (F.col("payment_id") == F.col("_lp")) & place.eqNullSafe(F.col("_last")), "left")
            .withColumn("is_final", F.col("_last").isNotNull()).drop("_lp", "_last"))


# --- M7 / M8 -------------------------------------------------------------------------

def apply_testimonials(g: Garage, submissions: DataFrame, as_of: Date) -> DataFrame:
    """M7: (submission_seq, customer_id, service_id, mechanic_id, rating, comment).

    Required fields, rating 1..5, service exists, mechanic exists when
    given, and no earlier testimonial of the customer for the same service
    and mechanic (NULL-safe, P11) -- stored or earlier in the batch.
    Accepted rows start unapproved and unfeatured, dated ``as_of``.
    """
    svc = g.services.select(F.col("id").alias("_sid")).distinct()
    mech = g.mechanics.select(F.col("id").alias("_mid")).distinct()
    seen = (g.testimonials.select(F.col("customer_id").alias("_c"), F.col("service_id").alias("_s"),
                                  F.col("mechanic_id").alias("_m")).distinct().withColumn("_dup", F.lit(True)))
    submissions = number_rows(submissions, ["submission_seq", "customer_id", "service_id", "mechanic_id", "rating", "comment"], out="_row")
    s = (submissions.join(svc, F.col("service_id") == F.col("_sid"), "left")
         .join(mech, F.col("mechanic_id") == F.col("_mid"), "left")
         .join(seen, (F.col("customer_id") == F.col("_c")) & (F.col("service_id") == F.col("_s"))
               & F.col("mechanic_id").eqNullSafe(F.col("_m")), "left"))
    base = first_reason(
        (is_falsy(F.col("service_id")) | is_falsy(F.col("rating")) | is_falsy(F.col("comment")), R_TESTIMONIAL_REQUIRED),
        ((F.col("rating") < 1) | (F.col("rating") > 5), R_RATING_RANGE),
        (F.col("_sid").isNull(), R_SERVICE_NOT_FOUND),
        (F.col("mechanic_id").isNotNull() & F.col("_mid").isNull(), R_MECHANIC_NOT_FOUND),
        (F.col("_dup").isNotNull(), R_ALREADY_REVIEWED))
    s = s.withColumn("_r", base)
    # grouping treats NULL mechanic ids as equal, like IS NOT DISTINCT FROM
    first = (s.where(F.col("_r").isNull()).groupBy("customer_id", "service_id", "mechanic_id")
             .agg(F.min("_row").alias("_first")))
    s = s.join(
        first.select(F.col("customer_id").alias("_fc"), F.col("service_id").alias("_fs"),
                     F.col("mechanic_id").alias("_fm"), "_first"),
        (F.col("customer_id") == F.col("_fc")) & (F.col("service_id") == F.col("_fs"))
        & F.col("mechanic_id").eqNullSafe(F.col("_fm")), "left")
    reason = F.coalesce(F.col("_r"), F.when(F.col("_row") != F.col("_first"), F.lit(R_ALREADY_REVIEWED)))
    ok = reason.isNull()
    return s.select("submission_seq", "customer_id", "service_id", "mechanic_id", "rating", "comment",
                    reason.alias("reject_reason"), F.when(ok, _d(as_of)).alias("date"),
                    F.when(ok, F.lit(False)).alias("approved"), F.when(ok, F.lit(False)).alias("featured"))


def segmented_last(df: DataFrame, key: str, order: str, value: str, out: str, partitions: int | None = None) -> DataFrame:
    """For every row, the last non-NULL ``value`` strictly before it (by ``order``) within ``key``.

    A hot key is not sent to one task: rows are range-partitioned on
    (key, order); a window over (partition, key) gives the in-partition
    running value; each (partition, key)'s final value is a carry, and a
    window over the small carry table (one row per partition and key)
    supplies the value coming from earlier partitions.  The partitioned rows
    are stored (shared checkpoint folder) so the partition ids the
    two branches read are the same; their number follows the rows.
    """
    # evaluated once, before the range bounds are sampled
    r = dealt(stored(df), key, [order], partitions)
    w_in = (Window.partitionBy("_p", key).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_local", F.last(value, ignorenulls=True).over(w_in))
    # one carry row per (partition, key) present -- also for groups holding no value themselves
    carry = r.groupBy("_p", key).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    w_c = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("_in", F.last("_end", ignorenulls=True).over(w_c)).select(
        F.col("_p").alias("_cp"), F.col(key).alias("_ck"), "_in")
    return (r.join(carry, (F.col("_p") == F.col("_cp")) & (F.col(key) == F.col("_ck")), "left")
            .withColumn(out, F.coalesce(F.col("_local"), F.col("_in")))
            .drop("_local", "_in", "_ck", "_cp", "_p"))


def moderate_testimonials(g: Garage, actions: DataFrame) -> DataFrame:
    """M8: (action_seq, testimonial_id, action approve|feature, value bool), applied in order.

    approve sets approved = value and resets featured; feature needs the
    testimonial approved at that moment (else refused).  The approval state
    before each action is ``segmented_last`` over the approve actions, with
    the stored value as the start.  ``approved_after`` / ``featured_after``
    are the state after each accepted action.
    """
    t = g.testimonials.select(F.col("id").alias("_tid"), F.col("approved").alias("_a0"),
                              F.col("featured").alias("_f0"))
    a = actions.join(t, F.col("testimonial_id") == F.col("_tid"), "left")
    a = a.withColumn("_appr_val", F.when(F.col("action") == "approve", F.col("value")))
    a = segmented_last(a, "testimonial_id", "action_seq", "_appr_val", "_appr_before")
    approved_before = F.coalesce(F.col("_appr_before"), F.col("_a0"))
    reason = first_reason((F.col("_tid").isNull(), R_TESTIMONIAL_NOT_FOUND),
                           ((F.col("action") == "feature") & F.col("value") & ~approved_before, R_FEATURE_UNAPPROVED))
    ok = reason.isNull()
    return a.select("action_seq", "testimonial_id", "action", "value", reason.alias("reject_reason"),
                    F.when(ok, F.when(F.col("action") == "approve", F.col("value")).otherwise(approved_before))
                    .alias("approved_after"),
                    F.when(ok, F.when(F.col("action") == "approve", F.lit(False)).otherwise(F.col("value")))
                    .alias("featured_after"))


# --- M9 / M10 -------------------------------------------------------------------------

def partial_update(old: DataFrame, patches: DataFrame, key: str = "id", seq: str = "patch_seq",
                   fields: str = "fields") -> DataFrame:
    """M9: only supplied columns change; presence (``fields`` array) differs from NULL.

    Several patches of one row apply in ``seq`` order: per column the last
    patch that supplies it wins (``max`` of (seq, value), a partial aggregate).
    """
    cols = [c for c in old.columns if c != key and c in patches.columns]
    aggs = []
    for c in cols:
        supplied = F.array_contains(F.col(fields), c)
        # max of (seq, value) over the patches that supply c: the last one wins, NULL when none does
        aggs.append(F.max(F.when(supplied, F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))).alias(f"_p_{c}"))
    per_key = patches.groupBy(F.col(key).alias("_pk")).agg(*aggs)
    j = old.join(per_key, F.col(key) == F.col("_pk"))
    changed = j.select(*[F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v")).otherwise(F.col(c)).alias(c)
                         if c in cols else F.col(c) for c in old.columns])
    return merge_snapshot(old, changed, key)


def replace_child_set(old: DataFrame, new_sets: DataFrame, parent_key: str, valid: Column) -> DataFrame:
    """Replace each parent's child rows by its new set, all or nothing.

    A parent whose new set has an invalid row keeps its old rows
    (``min(valid)`` per parent, a partial aggregate).  Returns the new table
    version with ``replaced`` telling which parents changed.
    """
    ok = new_sets.groupBy(F.col(parent_key).alias("_pk")).agg(F.min(F.coalesce(valid, F.lit(False))).alias("_ok"))
    good = ok.where("_ok").select("_pk")
    kept = old.join(good, F.col(parent_key) == F.col("_pk"), "left_anti").withColumn("replaced", F.lit(False))
    fresh = (new_sets.join(good, F.col(parent_key) == F.col("_pk"), "left_semi").select(*old.columns)
             .withColumn("replaced", F.lit(True)))
    return kept.unionByName(fresh)


def availability_valid() -> Column:
    """M10 slot rule: day 0..6, start and end present, start before end."""
    return (F.col("day_of_week").between(0, 6) & F.col("start_min").isNotNull() & F.col("end_min").isNotNull()
            & (F.col("start_min") < F.col("end_min")))


# --- M11 / M12 / M13 --------------------------------------------------------------------

def cascade_delete_users(g: Garage, user_ids: DataFrame) -> Garage:
    """Delete users with the reference's cascade, as new table versions.

    customer: its bookings, testimonials, vehicles and customer row go;
    mechanic: bookings keep the row with ``mechanic_id`` NULL, the mechanic
    row goes; every user: activity rows go, ``created_by`` is NULLed.
    Payments of a deleted booking go with it (ON DELETE CASCADE); so do, by our
    rule, its mechanic tasks and field notes.
    All steps are semi / anti joins against the (small) deleted key sets.
    """
    ids = user_ids.select(F.col("user_id").alias("_u")).distinct()
    gone_c = g.customers.join(ids, F.col("user_id") == F.col("_u"), "left_semi").select(F.col("id").alias("_gc"))
    gone_m = g.mechanics.join(ids, F.col("user_id") == F.col("_u"), "left_semi").select(F.col("id").alias("_gm"))
    b = g.bookings.join(gone_c, F.col("customer_id") == F.col("_gc"), "left_anti")
    b = (b.join(gone_m.withColumn("_hit", F.lit(True)), F.col("mechanic_id") == F.col("_gm"), "left")
         .withColumn("mechanic_id", F.when(F.col("_hit").isNull(), F.col("mechanic_id"))).drop("_gm", "_hit"))
    b = (b.join(ids.withColumn("_uh", F.lit(True)), F.col("created_by") == F.col("_u"), "left")
         .withColumn("created_by", F.when(F.col("_uh").isNull(), F.col("created_by"))).drop("_u", "_uh"))
    gone_b = g.bookings.join(gone_c, F.col("customer_id") == F.col("_gc"), "left_semi")
    out = g.as_dict()
    out.update(_without_booking_children(g, gone_b))
    out.update(
        bookings=b.select(*g.bookings.columns),
        testimonials=g.testimonials.join(gone_c, F.col("customer_id") == F.col("_gc"), "left_anti"),
        vehicles=g.vehicles.join(gone_c, F.col("customer_id") == F.col("_gc"), "left_anti"),
        customers=g.customers.join(gone_c, F.col("id") == F.col("_gc"), "left_anti"),
        mechanics=g.mechanics.join(gone_m, F.col("id") == F.col("_gm"), "left_anti"),
        activity_log=g.activity_log.join(ids, F.col("user_id") == F.col("_u"), "left_anti"),
        users=g.users.join(ids, F.col("id") == F.col("_u"), "left_anti"),
    )
    return Garage(**out)


def _without_booking_children(g: Garage, gone_bookings: DataFrame) -> dict[str, DataFrame]:
    """Payments, tasks and field notes of the bookings left; children that named no booking stay."""
    gone = gone_bookings.select(F.col("id").alias("_gb"))
    return {t: g.as_dict()[t].join(gone, F.col("booking_id") == F.col("_gb"), "left_anti")
            for t in ("payments", "mechanic_tasks", "field_notes")}


def delete_services(g: Garage, service_ids: DataFrame) -> Garage:
    """Delete services; their bookings go too (ON DELETE CASCADE), and those bookings' payments, tasks and notes."""
    ids = service_ids.select(F.col("service_id").alias("_s")).distinct()
    out = g.as_dict()
    out.update(_without_booking_children(g, g.bookings.join(ids, F.col("service_id") == F.col("_s"), "left_semi")))
    out.update(services=g.services.join(ids, F.col("id") == F.col("_s"), "left_anti"),
               bookings=g.bookings.join(ids, F.col("service_id") == F.col("_s"), "left_anti"))
    return Garage(**out)


def delete_schedules(g: Garage, ids: DataFrame) -> tuple[DataFrame, Garage]:
    """Delete bookings by id; refused for unknown ids.  Returns the decisions and the tables left."""
    known = g.bookings.select(F.col("id").alias("_k"))
    d = ids.select("booking_id").distinct().join(known, F.col("booking_id") == F.col("_k"), "left")
    reason = first_reason((F.col("_k").isNull(), R_SCHEDULE_NOT_FOUND))
    decided = d.select("booking_id", reason.alias("reject_reason"), reason.isNull().alias("deleted"))
    gone = g.bookings.join(ids.select("booking_id").distinct(), F.col("id") == F.col("booking_id"), "left_semi")
    left = g.bookings.join(ids.select("booking_id").distinct(), F.col("id") == F.col("booking_id"), "left_anti")
    return decided, Garage(**(g.as_dict() | _without_booking_children(g, gone) | {"bookings": left}))


def delete_vehicles(g: Garage, vehicle_ids: DataFrame) -> DataFrame:
    """Vehicle deletes, refused while a booking uses the vehicle."""
    used = g.bookings.select(F.col("vehicle_id").alias("_uv")).distinct().withColumn("_used", F.lit(True))
    known = g.vehicles.select(F.col("id").alias("_kv")).distinct()
    v = (vehicle_ids.join(known, F.col("vehicle_id") == F.col("_kv"), "left")
         .join(used, F.col("vehicle_id") == F.col("_uv"), "left"))
    reason = first_reason((F.col("_kv").isNull(), R_VEHICLE_NOT_FOUND), (F.col("_used").isNotNull(), R_VEHICLE_IN_USE))
    return v.select("vehicle_id", reason.alias("reject_reason"), reason.isNull().alias("deleted"))


def fill_unowned_vehicles(g: Garage) -> DataFrame:
    """Give every owner-less vehicle to the first customer by name (then id).

    The first customer is a top-1 scalar subquery, evaluated once.
    """
    first = (g.customers.join(g.users.select(F.col("id").alias("_uid"), "name"), F.col("user_id") == F.col("_uid"))
             .orderBy(F.col("name").asc_nulls_last(), F.col("id")).limit(1).select("id"))
    return g.vehicles.withColumn("customer_id", F.coalesce(F.col("customer_id"), first.scalar()))


# --- M15 / M16 / M17 -------------------------------------------------------------------------

def append_field_notes(g: Garage, notes: DataFrame) -> DataFrame:
    """(note_seq, booking_id, mechanic_id, note, date).

    Only the booking's assigned mechanic may write; accepted notes start
    pending.  ``booking_note_after`` is the newest accepted note per booking
    (by date, then seq -- ``max_by``), copied into the booking's notes.
    """
    held = stored(notes)  # evaluated once; moved once by booking, for its mechanic and for its newest note
    b = g.bookings.select(F.col("id").alias("_bid"), F.col("mechanic_id").alias("_bm"))
    same_mechanic = (F.col("mechanic_id") <= F.col("_bm")) & (F.col("mechanic_id") >= F.col("_bm"))  # no key of the join: it goes by booking alone
    reason = first_reason((is_falsy(F.col("booking_id")) | is_falsy(F.col("note")), R_NOTE_REQUIRED),
                           (F.col("_bid").isNull(), R_NOTE_NOT_ASSIGNED))
    accepted, out = F.col("reject_reason").isNull(), ["note_seq", "booking_id", "mechanic_id", "note", "date", "reject_reason", "status", "booking_note_after"]

    def checked(rows: DataFrame, bookings: DataFrame, mine: Column) -> DataFrame:
        return (rows.join(bookings, (F.col("booking_id") == F.col("_bid")) & mine, "left").withColumn("reject_reason", reason)
                .withColumn("status", F.when(accepted, F.lit("pending"))))

    hot = hot_keys(held, "booking_id")
    crowded, met = not hot.isEmpty(), F.col("booking_id") == F.col("_hk")
    few = held.where("booking_id is not null")
    few = few.join(F.broadcast(hot), met, "left_anti") if crowded else few
    newest = F.max_by("note", F.when(accepted, F.struct("date", "note_seq")))
    n = partitions_for(held.sparkSession, held.count())
    done = checked(few.repartition(n, "booking_id"), b, same_mechanic).withColumn(
        "booking_note_after", newest.over(Window.partitionBy("booking_id"))).select(*out)
    if not (nobody := held.where("booking_id is null")).isEmpty():  # notes that name no booking stay where they are
        done = done.unionByName(nobody.select("*", F.lit(R_NOTE_REQUIRED).alias("reject_reason"), F.lit(None).cast("string").alias("status"),
                                              F.lit(None).cast("string").alias("booking_note_after")).select(*out))
    if crowded:  # bookings with more notes than a task should have: their newest one is found by an aggregate and looked up
        many = checked(held.join(F.broadcast(hot), met, "left_semi"), b.join(F.broadcast(hot), F.col("_bid") == F.col("_hk"), "left_semi"),
                       F.col("mechanic_id") == F.col("_bm"))
        best = many.where(accepted).groupBy(F.col("booking_id").alias("_nb")).agg(
            F.max_by("note", F.struct("date", "note_seq")).alias("booking_note_after"))
        done = done.unionByName(many.join(best, F.col("booking_id") == F.col("_nb"), "left").select(*out))
    return done


def provision_users(g: Garage, rows: DataFrame) -> DataFrame:
    """(row_seq, email, name, role, specialization, experience, address).

    Rejects rows without e-mail, name or a known role, e-mails already stored
    or repeated earlier in the batch (compared as written) and mechanics
    without specialization/experience; accepted rows get a new
    user id after the largest existing one (M14 numbering), initials (E1)
    and their role row (customer or mechanic).
    """
    known = g.users.select(F.col("email").alias("_e")).distinct().withColumn("_known", F.lit(True))
    rows = number_rows(rows, ["row_seq", "email", "name", "role"], out="_row")
    r = rows.join(known, F.col("email") == F.col("_e"), "left")
    mech = F.col("role") == "mechanic"
    missing = is_falsy(F.col("email")) | is_falsy(F.col("name")) | is_falsy(F.col("role"))
    base = first_reason((missing, R_USER_REQUIRED), (~F.col("role").isin(*USER_ROLES), R_USER_ROLE), (F.col("_known").isNotNull(), R_EMAIL_IN_USE),
                         (mech & (is_falsy(F.col("specialization")) | F.col("experience").isNull()), R_MECHANIC_FIELDS))
    r = r.withColumn("_r", base)
    first = r.where(F.col("_r").isNull()).groupBy(F.col("email").alias("_fe")).agg(F.min("_row").alias("_first"))
    r = r.join(first, F.col("email") == F.col("_fe"), "left")
    reason = F.coalesce(F.col("_r"), F.when(F.col("_row") != F.col("_first"), F.lit(R_EMAIL_IN_USE)))
    r = r.withColumn("reject_reason", reason).drop("_e", "_known", "_r", "_fe", "_first")
    r = r.withColumnRenamed("_row", "_seq")
    top = g.users.select(F.max("id")).scalar()        # scalar subquery, evaluated once
    ok = number_rows(r.where(F.col("reject_reason").isNull()), ["_seq"])
    ok = ok.withColumn("user_id", F.coalesce(top, F.lit(0)) + F.col("row_no")).drop("row_no")
    bad = r.where(F.col("reject_reason").isNotNull()).withColumn("user_id", F.lit(None).cast("long"))
    return ok.unionByName(bad).drop("_seq").withColumn("initials", F.when(F.col("reject_reason").isNull(), initials("name")))


def backfill_renamed_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Fill new columns from their old names where NULL, then drop the old ones."""
    for old, new in renames.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return df
