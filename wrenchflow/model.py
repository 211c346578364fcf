"""Data model of the service shop: one fixed ``StructType`` per table.

Times of day are stored as minute-of-day integers (``start_min``): Spark has
no usable TIME column type, and minutes make interval arithmetic plain
integer arithmetic.  Money is ``DECIMAL(12,2)`` so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (vocabularies that must equal the reference's) ----------
BOOKING_STATUSES = ["pending", "confirmed", "in-progress", "completed", "cancelled"]
TASK_STATUSES = ["pending", "in-progress", "completed"]
PAYMENT_STATUSES = ["pending", "approved", "rejected"]
USER_ROLES = ["admin", "staff", "mechanic", "customer", "owner"]
USER_STATUSES = ["active", "inactive", "on-leave", "suspended"]
REPORT_TYPES = ["daily", "weekly", "monthly", "yearly"]
REVENUE_PERIODS = ["daily", "weekly", "monthly", "yearly"]
INSIGHT_RANGES = ["month", "quarter", "year"]
DEFAULT_DURATION_MIN = 60     # booking length when the service has no estimate
TAX_RATE_HISTORY = "0.10"     # tax shown on settled payments
SLOT_STEP_MIN = 30            # grid of offered start times (our rule)
LABEL_UNKNOWN_CUSTOMER = "Unknown Customer"
LABEL_UNKNOWN_SERVICE = "Unknown Service"
LABEL_NO_MECHANIC = "Belum ditugaskan"   # "not yet assigned"
LABEL_ADMIN = "Admin"
# -------------------------------------------------------------------------

MONEY = T.DecimalType(12, 2)


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "bookings": _s(
        ("id", T.StringType()), ("visit_id", T.LongType()), ("customer_id", T.LongType()),
        ("service_id", T.LongType()), ("mechanic_id", T.LongType()), ("vehicle_id", T.LongType()),
        ("booking_date", T.DateType()), ("start_min", T.IntegerType()), ("status", T.StringType()),
        ("notes", T.StringType()), ("customer_name", T.StringType()), ("total_price", MONEY),
        ("rating", T.IntegerType()), ("started_at", T.TimestampNTZType()),
        ("completed_at", T.TimestampNTZType()), ("created_by", T.LongType()),
    ),
    "services": _s(
        ("id", T.LongType()), ("name", T.StringType()), ("description", T.StringType()),
        ("category", T.StringType()), ("price", MONEY), ("estimated_time", T.IntegerType()),
        ("in_stock", T.BooleanType()), ("featured", T.BooleanType()), ("stock", T.IntegerType()),
    ),
    "users": _s(
        ("id", T.LongType()), ("name", T.StringType()), ("email", T.StringType()),
        ("role", T.StringType()), ("status", T.StringType()),
    ),
    "customers": _s(
        ("id", T.LongType()), ("user_id", T.LongType()), ("phone", T.StringType()),
        ("address", T.StringType()), ("total_bookings", T.LongType()),
    ),
    "mechanics": _s(
        ("id", T.LongType()), ("user_id", T.LongType()), ("specialization", T.StringType()),
        ("experience", T.IntegerType()), ("phone", T.StringType()), ("rating", T.DoubleType()),
    ),
    "vehicles": _s(
        ("id", T.LongType()), ("customer_id", T.LongType()), ("make", T.StringType()),
        ("model", T.StringType()), ("year", T.IntegerType()), ("license_plate", T.StringType()),
        ("vin", T.StringType()), ("color", T.StringType()),
    ),
    "payments": _s(
        ("id", T.LongType()), ("booking_id", T.StringType()), ("visit_id", T.LongType()),
        ("payment_method", T.StringType()), ("is_down_payment", T.BooleanType()),
        ("down_payment_percent", T.IntegerType()), ("down_payment_amount", MONEY),
        ("payment_status", T.StringType()), ("admin_notes", T.StringType()),
        ("payment_date", T.TimestampNTZType()), ("created_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
    ),
    "testimonials": _s(
        ("id", T.LongType()), ("customer_id", T.LongType()), ("service_id", T.LongType()),
        ("mechanic_id", T.LongType()), ("rating", T.IntegerType()), ("comment", T.StringType()),
        ("date", T.DateType()), ("approved", T.BooleanType()), ("featured", T.BooleanType()),
    ),
    "mechanic_availability": _s(
        ("mechanic_id", T.LongType()), ("day_of_week", T.IntegerType()),
        ("start_min", T.IntegerType()), ("end_min", T.IntegerType()),
    ),
    "mechanic_tasks": _s(
        ("id", T.LongType()), ("booking_id", T.StringType()), ("mechanic_id", T.LongType()),
        ("status", T.StringType()), ("start_min", T.IntegerType()), ("end_min", T.IntegerType()),
    ),
    "field_notes": _s(
        ("id", T.LongType()), ("booking_id", T.StringType()), ("mechanic_id", T.LongType()),
        ("note", T.StringType()), ("date", T.DateType()), ("parts_needed", T.StringType()),
        ("status", T.StringType()),
    ),
    "customer_messages": _s(
        ("customer_id", T.LongType()), ("turn", T.LongType()), ("type", T.StringType()),
        ("is_read", T.BooleanType()), ("message", T.StringType()), ("staff_id", T.LongType()), ("booking_id", T.StringType()),
    ),
    "activity_log": _s(
        ("id", T.LongType()), ("user_id", T.LongType()), ("action", T.StringType()),
        ("detail", T.StringType()), ("created_at", T.TimestampNTZType()), ("ok", T.BooleanType()),
        ("ip_address", T.StringType()),
    ),
}

TABLES = list(SCHEMAS)
