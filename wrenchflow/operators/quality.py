"""Data-quality rules (D1-D5): validation chains as a column rule engine.

A rule is (field, valid-condition, message[, applies-when]).  ``validate``
adds an ``errors`` array of {field, message} per row, built with
``array_compact(array(when(~ok, struct)))`` -- one projection, no UDF, no
shuffle.  ``quality_report`` counts errors per (field, message) with a
partial aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.model import BOOKING_STATUSES, SCHEMAS


@dataclass(frozen=True)
class Rule:
    field: str
    ok: Column
    message: str
    when: Column | None = None     # rule applies only where this holds


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")


def _len_between(c: str, lo: int, hi: int) -> Column:
    n = F.length(F.col(c).cast("string"))
    return (n >= lo) & (n <= hi)


def _int_at_least(c: str, lo: int) -> Column:
    v = F.col(c).cast("string").try_cast("long")
    return v.isNotNull() & (v >= lo)


# --- fixed values: messages and patterns of the reference's rule chains ---
EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
TIME_RE = r"^([0-1]?[0-9]|2[0-3]):[0-5][0-9]$"
PLATE_RE = r"^[A-Z0-9 -]+$"
VIN_RE = r"^[A-HJ-NPR-Z0-9]+$"
BOOKING_ID_RE = r"^B-\d+$"
USER_FORM_ROLES = ["admin", "staff", "mechanic", "customer"]
USER_FORM_STATUSES = ["active", "inactive", "on-leave", "suspended"]
NOTE_STATUSES = ["pending", "in-progress", "completed", "cancelled"]
MSG_EMAIL = "Email harus valid"
MSG_NAME_EMPTY = "Nama tidak boleh kosong"
MSG_NAME_LEN = "Nama harus antara 3-100 karakter"
MSG_ROLE = "Role tidak valid"
MSG_STATUS = "Status tidak valid"
MSG_SPECIALIZATION = "Specialization wajib diisi untuk mechanic"
MSG_EXPERIENCE = "Experience harus berupa angka positif"
MSG_SERVICE_NAME_EMPTY = "Nama layanan tidak boleh kosong"
MSG_SERVICE_NAME_LEN = "Nama layanan harus antara 3-100 karakter"
MSG_PRICE = "Harga harus berupa angka positif"
MSG_CATEGORY = "Kategori tidak boleh kosong"
MSG_ESTIMATE = "Estimasi waktu harus berupa angka positif"
MSG_SERVICE_ID = "ID layanan harus valid"
MSG_VEHICLE_ID = "ID kendaraan harus valid"
MSG_DATE = "Format tanggal tidak valid"
MSG_TIME = "Format waktu tidak valid (HH:MM)"
MSG_CUSTOMER_ID = "ID pelanggan harus valid"
MSG_MECHANIC_ID = "ID mekanik harus valid"
MSG_BOOKING_ID_EMPTY = "ID booking tidak boleh kosong"
MSG_BOOKING_ID_FORMAT = "Format ID booking tidak valid (B-XXXX)"
MSG_NOTE_EMPTY = "Catatan tidak boleh kosong"
MSG_MAKE = "Merk kendaraan tidak boleh kosong"
MSG_MODEL = "Model kendaraan tidak boleh kosong"
MSG_YEAR = "Tahun kendaraan tidak valid"
MSG_PLATE_EMPTY = "Plat nomor tidak boleh kosong"
MSG_PLATE_FORMAT = "Format plat nomor tidak valid"
MSG_VIN_LEN = "VIN harus 17 karakter"
MSG_VIN_FORMAT = "Format VIN tidak valid"
MSG_RATING = "Rating harus antara 1-5"
MSG_COMMENT = "Komentar tidak boleh kosong"
MSG_MESSAGE = "Pesan tidak boleh kosong"
# ---------------------------------------------------------------------------


def user_rules() -> list[Rule]:
    mech = F.col("role") == "mechanic"
    return [
        Rule("email", F.coalesce(F.col("email").rlike(EMAIL_RE), F.lit(False)), MSG_EMAIL),
        Rule("name", _present("name"), MSG_NAME_EMPTY),
        Rule("name", F.coalesce(_len_between("name", 3, 100), F.lit(False)), MSG_NAME_LEN),
        Rule("role", F.coalesce(F.col("role").isin(*USER_FORM_ROLES), F.lit(False)), MSG_ROLE),
        Rule("status", F.col("status").isin(*USER_FORM_STATUSES), MSG_STATUS, F.col("status").isNotNull()),
        Rule("specialization", _present("specialization"), MSG_SPECIALIZATION, mech),
        Rule("experience", _int_at_least("experience", 0), MSG_EXPERIENCE, mech),
    ]


def service_rules() -> list[Rule]:
    return [
        Rule("name", _present("name"), MSG_SERVICE_NAME_EMPTY),
        Rule("name", F.coalesce(_len_between("name", 3, 100), F.lit(False)), MSG_SERVICE_NAME_LEN),
        Rule("price", F.coalesce(F.col("price").cast("double") >= 0, F.lit(False)), MSG_PRICE),
        Rule("category", _present("category"), MSG_CATEGORY),
        Rule("estimated_time", _int_at_least("estimated_time", 1), MSG_ESTIMATE),
    ]


def booking_rules(time_col: str = "booking_time") -> list[Rule]:
    return [
        Rule("service_id", _int_at_least("service_id", 1), MSG_SERVICE_ID),
        Rule("vehicle_id", _int_at_least("vehicle_id", 1), MSG_VEHICLE_ID),
        Rule("booking_date", F.col("booking_date").cast("string").try_cast("date").isNotNull(), MSG_DATE),
        Rule(time_col, F.coalesce(F.col(time_col).rlike(TIME_RE), F.lit(False)), MSG_TIME),
        Rule("customer_id", _int_at_least("customer_id", 1), MSG_CUSTOMER_ID, F.col("customer_id").isNotNull()),
        Rule("status", F.coalesce(F.col("status").isin(*BOOKING_STATUSES), F.lit(False)), MSG_STATUS),
        Rule("id", F.coalesce(F.col("id").rlike(BOOKING_ID_RE), F.lit(False)), MSG_BOOKING_ID_FORMAT),
    ]


def vehicle_rules(max_year: int) -> list[Rule]:
    year = F.col("year").cast("string").try_cast("int")
    vin = F.col("vin").isNotNull() & (F.col("vin") != "")
    return [
        Rule("make", _present("make"), MSG_MAKE),
        Rule("model", _present("model"), MSG_MODEL),
        Rule("year", year.isNotNull() & (year >= 1900) & (year <= max_year), MSG_YEAR),
        Rule("license_plate", _present("license_plate"), MSG_PLATE_EMPTY),
        Rule("license_plate", F.coalesce(F.col("license_plate").rlike(PLATE_RE), F.lit(False)), MSG_PLATE_FORMAT),
        Rule("vin", F.length("vin") == 17, MSG_VIN_LEN, vin),
        Rule("vin", F.col("vin").rlike(VIN_RE), MSG_VIN_FORMAT, vin),
        Rule("customer_id", _int_at_least("customer_id", 1), MSG_CUSTOMER_ID, F.col("customer_id").isNotNull()),
    ]


def testimonial_rules() -> list[Rule]:
    r = F.col("rating").cast("string").try_cast("int")
    return [
        Rule("service_id", _int_at_least("service_id", 1), MSG_SERVICE_ID),
        Rule("mechanic_id", _int_at_least("mechanic_id", 1), MSG_MECHANIC_ID, F.col("mechanic_id").isNotNull()),
        Rule("rating", r.isNotNull() & (r >= 1) & (r <= 5), MSG_RATING),
        Rule("comment", _present("comment"), MSG_COMMENT),
    ]


def field_note_rules() -> list[Rule]:
    return [
        Rule("booking_id", _present("booking_id"), MSG_BOOKING_ID_EMPTY),
        Rule("note", _present("note"), MSG_NOTE_EMPTY),
        Rule("status", F.col("status").isin(*NOTE_STATUSES), MSG_STATUS, F.col("status").isNotNull()),
    ]


def message_rules() -> list[Rule]:
    return [Rule("message", _present("message"), MSG_MESSAGE)]


_ERR = T.StructType([T.StructField("field", T.StringType()), T.StructField("message", T.StringType())])


def validate(df: DataFrame, rules: list[Rule], out: str = "errors") -> DataFrame:
    """Add ``out`` = array of {field, message} for every failed rule (empty = valid)."""
    checks = []
    for r in rules:
        failed = ~F.coalesce(r.ok, F.lit(False))
        if r.when is not None:
            failed = F.coalesce(r.when, F.lit(False)) & failed
        checks.append(F.when(failed, F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("message"))))
    return df.withColumn(out, F.array_compact(F.array(*checks)).cast(T.ArrayType(_ERR)))


def quality_report(validated: DataFrame, table: str, errors: str = "errors") -> DataFrame:
    """Error counts per (field, message)."""
    e = validated.select(F.explode(errors).alias("e"))
    return (e.groupBy(F.col("e.field").alias("field"), F.col("e.message").alias("message"))
            .agg(F.count("*").alias("error_count")).withColumn("table_name", F.lit(table)))


def schema_check(df: DataFrame, table: str) -> DataFrame:
    """D3: per expected column: presence, expected and actual type, NULL count.

    Types come from metadata; the NULL counts are one aggregate pass over
    the table, unpivoted with ``stack``.
    """
    expected = SCHEMAS[table]
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = [f.name for f in expected.fields if f.name in actual]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    stack = ", ".join(f"'{c}', `{c}`" for c in present)
    long = counts.select(F.expr(f"stack({len(present)}, {stack}) AS (column_name, null_count)"))
    meta = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), actual.get(f.name)) for f in expected.fields],
        "column_name string, expected_type string, actual_type string")
    return (meta.join(long, "column_name", "left")
            .withColumn("present", F.col("actual_type").isNotNull())
            .withColumn("type_matches", F.coalesce(F.col("actual_type") == F.col("expected_type"), F.lit(False)))
            .withColumn("table_name", F.lit(table)))


def status_vocabulary_check(df: DataFrame, col: str = "status", vocabulary: list[str] = BOOKING_STATUSES) -> DataFrame:
    """Every distinct status with its count, whether it is in the vocabulary,
    and the '_'->'-' repair when that lands in it (``in_progress``)."""
    repaired = F.regexp_replace(F.col(col), "_", "-")
    return (df.groupBy(col).agg(F.count("*").alias("row_count"))
            .withColumn("in_vocabulary", F.coalesce(F.col(col).isin(*vocabulary), F.lit(False)))
            .withColumn("repair", F.when(~F.col("in_vocabulary") & repaired.isin(*vocabulary), repaired)))


# D5 error classes: names of reject reasons produced by U2 / J22 / D1
ERROR_UNIQUE = "unique_violation"
ERROR_FOREIGN_KEY = "foreign_key_violation"
ERROR_NOT_NULL = "not_null_violation"
ERROR_INVALID = "validation_error"


def error_class(reason: Column) -> Column:
    """Map a reject reason to its error class."""
    return (F.when(reason.isNull(), F.lit(None))
            .when(reason.rlike("already|duplicate"), ERROR_UNIQUE)
            .when(reason.rlike("not found|missing"), ERROR_FOREIGN_KEY)
            .when(reason.rlike("required|kosong"), ERROR_NOT_NULL)
            .otherwise(ERROR_INVALID))


def duplicate_keys(df: DataFrame, keys: list[str], out: str = "row_count") -> DataFrame:
    """Key combinations (NULLs equal, as ``IS NOT DISTINCT FROM``) held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias(out)).where(F.col(out) > 1)
