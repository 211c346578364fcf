"""Stand-in change sets for the batch operators, derived from the bound tables.

These only produce rows in the schema each operator expects (requests,
decisions, actions ...); all checks and effects run in ``operators.changes``.
Every set grows with the tables it is derived from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchflow.functions.exprs import hhmm
from wrenchflow.sources.tables import Garage

BIG = 10 ** 12


def _key(c: str = "id"):
    """Numeric part of a ``B-<n>`` id."""
    return F.substring(F.col(c), 3, 40).cast("long")


def new_booking_requests(g: Garage) -> DataFrame:
    """Every job is booked again 30 days later at the same time, paid like its visit: by the customer, now and then
    by staff (for the same customer, its neighbour or nobody) or a mechanic; some forget the date."""
    b = g.bookings
    p = g.payments.select(F.col("visit_id").alias("_pv"), "payment_method", "is_down_payment",
                          "down_payment_percent", "down_payment_amount")
    key = _key()
    role = F.when(key % 10 == 3, "staff").when(key % 50 == 7, "mechanic").otherwise("customer")
    neighbour = F.greatest(F.col("customer_id") - 1, F.lit(1))
    named = F.when(key % 200 == 33, F.lit(None)).when(key % 20 == 13, neighbour).when(key % 10 == 3, F.col("customer_id"))
    return (b.join(p, F.col("visit_id") == F.col("_pv"), "left").select(
        key.alias("request_seq"), role.alias("role"),
        F.when(role == "customer", F.col("customer_id")).alias("requester_customer_id"), named.cast("long").alias("customer_id"),
        "service_id", "vehicle_id",
        F.when(key % 13 != 5, F.date_add("booking_date", 30).cast("string")).alias("booking_date"),
        hhmm("start_min").alias("booking_time"), F.lit("follow-up").alias("notes"),
        F.lit(None).cast("long").alias("mechanic_id"), F.lit(None).cast("string").alias("customer_name"),
        "payment_method", F.col("is_down_payment").cast("string").alias("is_down_payment"),
        "down_payment_percent", "down_payment_amount"))


def vehicle_requests(g: Garage) -> DataFrame:
    """Per stored vehicle ten registrations, step by step over all vehicles: its own plate again; a new plate and VIN; that
    plate with another VIN (refused, takes nothing); another plate with that VIN; a third plate with the first VIN
    (refused); a plate that every vehicle asks for; the VIN given with it; a stored VIN; faulty ones; the third plate by staff."""
    v = g.vehicles.select("id", "customer_id", "make", "model", "year", F.col("id").cast("string").alias("n"))
    text = lambda c, d=None: F.concat(F.lit(c), F.col("n")) if d is None else F.lit(d)
    none = F.lit(None).cast("string")
    steps = [(text("B "), none), (text("N "), text("W")), (text("N "), text("X")), (text("M "), text("X")), (text("K "), text("W")),
             (text("", "TEMP"), text("H")), (text("H "), text("H")), (text("S "), text("VIN")), (text("F "), F.lit("")), (text("K "), none)]
    parts = []
    for k, (plate, vin) in enumerate(steps):
        role, make = F.lit("customer"), F.col("make")
        if k == 8:
            role = F.when(F.col("id") % 3 == 0, "mechanic").when(F.col("id") % 3 == 1, "staff").otherwise("customer")
            make = F.when(F.col("id") % 6 != 2, F.col("make"))
        role = F.lit("staff") if k == 9 else role
        parts.append(v.select(
            (F.lit(k * BIG) + F.col("id")).alias("request_seq"), role.alias("role"), F.col("customer_id").alias("requester_customer_id"),
            (F.col("customer_id") if k == 9 else F.lit(None)).cast("long").alias("customer_id"), make.alias("make"), "model", "year",
            plate.alias("license_plate"), vin.alias("vin"), F.lit("white").alias("color")))
    return reduce(DataFrame.unionByName, parts)


def status_change_set(g: Garage) -> DataFrame:
    """Mechanics mirror their task statuses; each visit's lead mechanic completes its in-progress jobs;
    completed ones are reported in progress again."""
    t = g.mechanic_tasks.select(F.col("id").alias("change_seq"), "booking_id", F.col("status").alias("new_status"),
                                F.lit("mechanic").alias("actor_role"), F.col("mechanic_id").alias("actor_mechanic_id"))
    b = g.bookings
    lead = b.where(F.col("mechanic_id").isNotNull()).groupBy("visit_id").agg(F.min("mechanic_id").alias("lead"))
    c = (b.where(F.col("status") == "in-progress").join(lead, "visit_id")
         .select((F.lit(BIG) + _key()).alias("change_seq"), F.col("id").alias("booking_id"),
                 F.lit("completed").alias("new_status"), F.lit("mechanic").alias("actor_role"),
                 F.col("lead").alias("actor_mechanic_id")))
    reopened = t.where(F.col("new_status") == "completed").withColumn("new_status", F.lit("in-progress")).withColumn(
        "change_seq", F.col("change_seq") + 2 * BIG)
    return t.unionByName(c).unionByName(reopened)


def cancellation_requests(g: Garage) -> DataFrame:
    """Customers ask to cancel all their bookings; pending ones are asked twice."""
    c = g.customers.select(F.col("id").alias("_c"), "user_id")
    r = g.bookings.join(c, F.col("customer_id") == F.col("_c")).select(
        _key().alias("request_seq"), F.col("id").alias("booking_id"), "customer_id", "user_id", "status")
    again = r.where(F.col("status") == "pending").withColumn("request_seq", F.col("request_seq") + BIG)
    return r.unionByName(again).drop("status")


def task_status_changes(g: Garage) -> DataFrame:
    """Mechanics start their confirmed jobs (by booking id), finish running tasks (by task id) and then the
    jobs they started (by booking id)."""
    start = g.bookings.where(F.col("status") == "confirmed").select(
        _key().alias("change_seq"), F.col("id").alias("ref"), "mechanic_id",
        F.lit("in-progress").alias("status"), (F.col("start_min") + 5).alias("now_min"))
    finish = g.mechanic_tasks.where(F.col("status") == "in-progress").select(
        (F.lit(BIG) + F.col("id")).alias("change_seq"), F.col("id").cast("string").alias("ref"), "mechanic_id",
        F.lit("completed").alias("status"), (F.col("start_min") + 60).alias("now_min"))
    again = g.bookings.where(F.col("status") == "confirmed").select(
        (F.lit(2 * BIG) + _key()).alias("change_seq"), F.col("id").alias("ref"), "mechanic_id",
        F.lit("completed").alias("status"), (F.col("start_min") + 50).alias("now_min"))
    return start.unionByName(finish).unionByName(again)


def payment_decisions(g: Garage) -> DataFrame:
    """Pending payments: approve those with a down payment, reject the rest."""
    return g.payments.where(F.col("payment_status") == "pending").select(
        F.col("id").alias("decision_seq"), F.col("id").alias("payment_id"),
        F.when(F.col("is_down_payment"), "approve").otherwise("reject").alias("decision"),
        F.when(~F.col("is_down_payment"), F.lit("no down payment")).alias("admin_notes"))


def testimonial_submissions(g: Garage) -> DataFrame:
    """Every rated completed job is submitted as a review."""
    return g.bookings.where((F.col("status") == "completed") & F.col("rating").isNotNull()).select(
        _key().alias("submission_seq"), "customer_id", "service_id", "mechanic_id", "rating",
        F.concat(F.lit("Review of "), F.col("id")).alias("comment"))


def moderation_actions(g: Garage) -> DataFrame:
    """Pending reviews rated 4+ are approved then featured; low pending ones are featured first
    (refused); approved ones are featured when rated 4+, unfeatured otherwise."""
    t = g.testimonials
    pend, appr = t.where(~F.col("approved")), t.where(F.col("approved"))
    a1 = pend.where(F.col("rating") >= 4).select((F.col("id") * 2).alias("action_seq"), F.col("id").alias("testimonial_id"),
                                                 F.lit("approve").alias("action"), F.lit(True).alias("value"))
    a2 = pend.where(F.col("rating") >= 4).select((F.col("id") * 2 + 1).alias("action_seq"),
                                                 F.col("id").alias("testimonial_id"),
                                                 F.lit("feature").alias("action"), F.lit(True).alias("value"))
    a3 = pend.where(F.col("rating") < 4).select((F.col("id") * 2).alias("action_seq"), F.col("id").alias("testimonial_id"),
                                                F.lit("feature").alias("action"), F.lit(True).alias("value"))
    a4 = appr.select((F.col("id") * 2).alias("action_seq"), F.col("id").alias("testimonial_id"),
                     F.lit("feature").alias("action"), (F.col("rating") >= 4).alias("value"))
    return a1.unionByName(a2).unionByName(a3).unionByName(a4)


def service_patches(g: Garage) -> DataFrame:
    """Featured services get a 10 % price rise; nearly sold-out ones are marked out of stock."""
    s = g.services
    rise = s.where(F.col("featured")).select(
        F.lit(1).alias("patch_seq"), "id", F.round(F.col("price") * F.lit(1.10).cast("decimal(3,2)"), 2)
        .cast("decimal(12,2)").alias("price"), F.lit(None).cast("int").alias("stock"),
        F.lit(None).cast("boolean").alias("in_stock"), F.array(F.lit("price")).alias("fields"))
    out = s.where(F.col("stock") < 3).select(
        F.lit(2).alias("patch_seq"), "id", F.lit(None).cast("decimal(12,2)").alias("price"),
        F.lit(0).alias("stock"), F.lit(False).alias("in_stock"), F.array(F.lit("stock"), F.lit("in_stock")).alias("fields"))
    return rise.unionByName(out)


def availability_sets(g: Garage) -> DataFrame:
    """Every mechanic moves its week an hour later; trainees (experience 0) send a broken slot too."""
    a = g.mechanic_availability.select("mechanic_id", "day_of_week", (F.col("start_min") + 60).alias("start_min"),
                                       (F.col("end_min") + 60).alias("end_min"))
    broken = g.mechanics.where(F.col("experience") == 0).select(
        F.col("id").alias("mechanic_id"), F.lit(6).alias("day_of_week"), F.lit(600).alias("start_min"),
        F.lit(600).alias("end_min"))
    return a.unionByName(broken)


def field_note_appends(g: Garage) -> DataFrame:
    """Task mechanics log progress on their jobs; each visit's lead also notes every job of the visit."""
    t = g.mechanic_tasks.join(g.bookings.select(F.col("id").alias("_b"), "booking_date", "visit_id"),
                              F.col("booking_id") == F.col("_b"))
    own = t.select(F.col("id").alias("note_seq"), "booking_id", "mechanic_id",
                   F.concat(F.lit("progress "), F.col("id").cast("string")).alias("note"),
                   F.col("booking_date").alias("date"))
    b = g.bookings
    lead = b.where(F.col("mechanic_id").isNotNull()).groupBy("visit_id").agg(F.min("mechanic_id").alias("lead"))
    lead_notes = b.join(lead, "visit_id").select(
        (F.lit(BIG) + _key()).alias("note_seq"), F.col("id").alias("booking_id"), F.col("lead").alias("mechanic_id"),
        F.lit("lead check").alias("note"), F.col("booking_date").alias("date"))
    return own.unionByName(lead_notes)


def user_rows(g: Garage, conversations: DataFrame | None = None) -> DataFrame:
    """Mechanic accounts re-submitted (already known) and a customer account per chat thread;
    rows without e-mail or with an unknown role; apprentices of every mechanic, half of them without a specialization."""
    again = g.users.where(F.col("role") == "mechanic").select(
        F.col("id").alias("row_seq"), "email", "name", "role", F.lit("general").alias("specialization"),
        F.lit(1).alias("experience"), F.lit(None).cast("string").alias("address"))
    threads = g.customer_messages.select("customer_id").distinct().select(
        (F.lit(BIG) + F.col("customer_id")).alias("row_seq"),
        F.concat(F.lit("thread"), F.col("customer_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("Chat Customer "), F.col("customer_id").cast("string")).alias("name"),
        F.lit("customer").alias("role"), F.lit(None).cast("string").alias("specialization"),
        F.lit(None).cast("int").alias("experience"), F.lit("online").alias("address"))
    apprentices = g.users.where(F.col("role") == "mechanic").select(
        (F.lit(3 * BIG) + F.col("id")).alias("row_seq"), F.concat(F.lit("apprentice."), F.col("email")).alias("email"), "name", "role",
        F.when(F.col("id") % 2 == 0, F.lit("general")).alias("specialization"), F.lit(1).alias("experience"),
        F.lit(None).cast("string").alias("address"))
    wrong = g.users.where(F.col("role") == "customer").select(
        (F.lit(2 * BIG) + F.col("id")).alias("row_seq"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), F.col("email"))).alias("email"), "name",
        F.lit("pirate").alias("role"), F.lit(None).cast("string").alias("specialization"),
        F.lit(None).cast("int").alias("experience"), F.lit(None).cast("string").alias("address"))
    return again.unionByName(threads).unionByName(wrong).unionByName(apprentices)


def legacy_bookings(g: Garage) -> DataFrame:
    """Bookings in the pre-rename layout: pending rows still carry only the old ``date`` column."""
    return (g.bookings.withColumn("date", F.col("booking_date"))
            .withColumn("booking_date", F.when(F.col("status") != "pending", F.col("booking_date"))))
