"""Customer message threads (G1-G3; retired feature kept from its tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchflow.operators.enrich import customer_names
from wrenchflow.operators.ordered import place_within
from wrenchflow.sources.tables import Garage


def _names(g: Garage) -> DataFrame:
    return customer_names(g).select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"))


def _with_names(g: Garage, messages: DataFrame) -> DataFrame:
    """Messages with the names of customer, staff member and the booking's service, each where known."""
    staff = g.users.select(F.col("id").alias("_uid"), F.col("name").alias("staff_name"))
    service = (g.bookings.select(F.col("id").alias("_bid"), "service_id")
               .join(g.services.select(F.col("id").alias("_sid"), F.col("name").alias("service_name")), F.col("service_id") == F.col("_sid"))
               .select("_bid", "service_name"))
    return (messages.join(_names(g), F.col("customer_id") == F.col("_cid"), "left")
            .join(staff, F.col("staff_id") == F.col("_uid"), "left")
            .join(service, F.col("booking_id") == F.col("_bid"), "left").drop("_cid", "_uid", "_bid"))


def messages_by_customer(g: Garage) -> DataFrame:
    """G1: every customer's thread ordered by turn, with the names of customer, staff and service."""
    return _with_names(g, g.customer_messages).orderBy("customer_id", "turn")


def messages_by_booking(g: Garage) -> DataFrame:
    """G1: the messages about each booking ordered by turn, with the same names."""
    return _with_names(g, g.customer_messages.where(F.col("booking_id").isNotNull())).orderBy("booking_id", "turn", "customer_id")


def unread_messages(g: Garage) -> DataFrame:
    """Incoming, unread messages with the same names."""
    return _with_names(g, g.customer_messages.where((F.col("type") == "incoming") & ~F.col("is_read")))


# reject classes by status code: the thread has no fixed texts to match
R_FORBIDDEN, R_MISSING, R_UNKNOWN = "forbidden", "missing fields", "not found"


def apply_messages(g: Garage, sent: DataFrame) -> DataFrame:
    """(message_seq, role, customer_id, booking_id, message) sent in a batch.

    A customer sends (incoming) on a booking of its own; admin and staff reply
    (outgoing) to an existing customer; others are refused; a message needs its
    text and its booking (a reply its customer).  Accepted messages are
    unread and continue the customer's thread: ``turn`` follows the largest
    stored turn in ``message_seq`` order.
    """
    b = g.bookings.select(F.col("id").alias("_b"), F.col("customer_id").alias("_bc"))
    c = g.customers.select(F.col("id").alias("_c"))
    x = (sent.join(b, (F.col("booking_id") == F.col("_b")) & (F.col("customer_id") == F.col("_bc")), "left")
         .join(c, F.col("customer_id") == F.col("_c"), "left"))
    customer, staff = F.col("role") == "customer", F.col("role").isin("admin", "staff")
    empty = F.coalesce(F.col("message"), F.lit("")) == ""
    reason = (F.when(~F.coalesce(customer | staff, F.lit(False)), R_FORBIDDEN)
              .when(empty | (customer & F.col("booking_id").isNull()) | (staff & F.col("customer_id").isNull()), R_MISSING)
              .when((customer & F.col("_b").isNull()) | (staff & F.col("_c").isNull()), R_UNKNOWN))
    x = x.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    last = g.customer_messages.groupBy(F.col("customer_id").alias("_lc")).agg(F.max("turn").alias("_last"))
    # a thread's new turns are numbered in order; rejected rows stand apart
    x = place_within(x.withColumn("_thread", F.when(ok, F.col("customer_id"))), ["_thread"], [F.col("message_seq")], out="_n")
    return (x.withColumn("_n", F.col("_n") + 1).join(last, F.col("customer_id") == F.col("_lc"), "left")
            .select("message_seq", "role", "customer_id", "booking_id", "message", "reject_reason",
                    F.when(ok, F.when(customer, "incoming").otherwise("outgoing")).alias("type"),
                    F.when(ok, F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("turn"),
                    F.when(ok, F.lit(False)).alias("is_read")))


def mark_read(messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """Apply read receipts (customer_id, up_to_turn): incoming messages up to that turn become read."""
    r = receipts.groupBy(F.col("customer_id").alias("_rc")).agg(F.max("up_to_turn").alias("_upto"))
    j = messages.join(r, F.col("customer_id") == F.col("_rc"), "left")
    hit = (F.col("type") == "incoming") & (F.col("turn") <= F.col("_upto"))
    return j.withColumn("is_read", F.col("is_read") | F.coalesce(hit, F.lit(False))).drop("_rc", "_upto")


def reply_receipts(messages: DataFrame) -> DataFrame:
    """Receipts implied by replies: a reply reads every earlier incoming message."""
    return (messages.where(F.col("type") == "outgoing").groupBy("customer_id")
            .agg(F.max("turn").alias("up_to_turn")))
