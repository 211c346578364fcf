"""Fixture binding: shop tables derived from the driver's TPC-H-like tables.

This only *shapes* test input into the shop schema (``model.SCHEMAS``); it
does none of an operator's work.  Every registered query runs its operator
on these frames, so the work grows with the driver tables.  ``BINDING_SQL``
is the same definition as DuckDB CTEs, prefixed to every oracle query.

A line item is a job (booking); its order is the visit; the part is the
service; the supplier is the mechanic; the customer owns one vehicle per
order-priority digit.  Money is cast to DECIMAL(12,2) at once so both engines
sum it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchflow.session import partitions_for, written
from wrenchflow.sources.tables import Garage, conform

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

# Reference date of the fixture (bookings run 1995..2001, events Jan 2024).
AS_OF = "2001-07-15"
AS_OF_EVENTS = "2024-01-30"


class _LazyTables(dict):
    """Driver tables opened on first use (each open lists files and reads a footer)."""

    def __init__(self, spark: SparkSession, base: str):
        super().__init__()
        self._spark, self._base = spark, base

    def __missing__(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise KeyError(name)
        df = self._spark.read.parquet(f"{self._base}/{name}.parquet")
        self[name] = df
        return df


def driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _LazyTables(spark, sf_dir.rstrip("/"))


def _job_status() -> F.Column:
    ls, rf = F.col("l_linestatus"), F.col("l_returnflag")
    return (F.when((ls == "O") & (rf == "N"), "pending")
            .when((ls == "O") & (rf == "A"), "confirmed")
            .when(ls == "O", "in-progress")
            .when(rf == "R", "cancelled")
            .otherwise("completed"))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax"]
#: Shop tables that are made of job rows.
JOB_TABLES = ("bookings", "testimonials", "mechanic_tasks", "field_notes")


def _jobs(t: dict[str, DataFrame]) -> DataFrame:
    """Line items joined to their order, numbered within the order.

    (l_orderkey, l_linenumber) is not unique in the driver data, so the job
    number is a row_number per order over all line columns.  This window is
    fixture shaping only (the library never windows over an unbounded key);
    its groups are the lines of one order, which TPC-H caps at seven.

    Lines are numbered before they meet their order, so that one sort serves the window and
    the join; an order that stands m times gives each line m numbers.  The number of
    partitions follows the lines, so none grows with the tables.
    """
    lines = t["lineitem"]
    n = partitions_for(lines.sparkSession, lines.count())
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE[1:], "l_returnflag", "l_linestatus")
    lines = (lines.select(*_LINE, "l_returnflag", "l_linestatus").where("l_orderkey is not null").repartition(n, "l_orderkey")
             .withColumn("_nth", F.row_number().over(w)))
    copies = Window.partitionBy("o_orderkey").orderBy("o_custkey", "o_orderpriority")
    orders = (t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority").where("o_orderkey is not null").repartition(n, "o_orderkey")
              .withColumn("_copy", F.row_number().over(copies))
              .withColumn("_copies", F.count(F.lit(1)).over(copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("seq", (F.col("_nth") - 1) * F.col("_copies") + F.col("_copy"))
            .select(*_LINE, "o_custkey", "o_orderpriority", _job_status().alias("status"),
                    (F.col("l_orderkey") * 100 + F.col("seq")).alias("job_key")))


def _vehicle_id() -> F.Column:
    return F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("int")


def bind(spark: SparkSession, sf_dir: str, jobs_path: str | None = None) -> Garage:
    """Build every shop table (lazily) from the driver tables in ``sf_dir``.

    With ``jobs_path`` the numbered job rows (four tables derive from them)
    are written there once and read back, instead of being re-derived by
    each table that uses them; the files of bookings are then sorted by date.
    """
    t = driver_tables(spark, sf_dir)
    jobs = _jobs(t)
    if jobs_path:
        jobs = written(jobs, jobs_path)
    job_id = F.concat(F.lit("B-"), F.col("job_key").cast("string"))
    dated = jobs
    if jobs_path:
        # sorted where they lie: a date's rows are a run of pages in each file, and no row moves for it
        dated = jobs.sortWithinPartitions("l_shipdate", "job_key")
    done = F.col("status") == "completed"

    bookings = dated.select(
        job_id.alias("id"),
        F.col("l_orderkey").alias("visit_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("service_id"),
        F.when(F.col("status") != "pending", F.col("l_suppkey")).alias("mechanic_id"),
        _vehicle_id().alias("vehicle_id"),
        F.col("l_shipdate").cast("date").alias("booking_date"),
        (F.lit(480) + (F.col("l_linenumber") - 1) * 90).alias("start_min"),
        "status",
        F.col("l_extendedprice").cast("decimal(12,2)").alias("total_price"),
        F.when(done & (F.col("l_linenumber") <= 5), F.col("l_linenumber")).alias("rating"),
        F.when(done, F.col("l_shipdate")).alias("started_at"),
        F.when(done, F.timestamp_add("HOUR", F.col("l_quantity").cast("int"),
                                     F.col("l_shipdate"))).alias("completed_at"),
    )

    p = t["part"]
    services = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"), F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        (F.col("p_size") + 15).alias("estimated_time"),
        (F.col("p_size") > 5).alias("in_stock"),
        (F.col("p_brand") == "Brand#2").alias("featured"),
        F.col("p_size").alias("stock"),
    )

    c, s = t["customer"], t["supplier"]
    users = c.select(
        (F.lit(1000000) + F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.lit("customer").alias("role"),
        F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"),
    ).unionByName(s.select(
        (F.lit(2000000) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
        F.lit("mechanic").alias("role"),
        F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active").alias("status"),
    ))

    customers = c.select(
        F.col("c_custkey").alias("id"), (F.lit(1000000) + F.col("c_custkey")).alias("user_id"),
        F.col("c_mktsegment").alias("address"))

    nation = t["nation"].select("n_nationkey", "n_name")
    mechanics = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), (F.lit(2000000) + F.col("s_suppkey")).alias("user_id"),
        F.col("n_name").alias("specialization"), (F.col("s_suppkey") % 20).cast("int").alias("experience"))

    owned = (t["orders"].join(c, F.col("o_custkey") == F.col("c_custkey"))
             .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .select(_vehicle_id().alias("id"), F.col("o_custkey").alias("customer_id"),
                     F.col("n_name").alias("make"),
                     F.substring("o_orderpriority", 3, 1 << 20).alias("model"))
             .distinct())
    vid = F.col("id")
    vehicles = owned.select(
        "id", F.when(vid % 97 != 0, F.col("customer_id")).alias("customer_id"), "make", "model",
        (F.lit(1990) + vid % 30).cast("int").alias("year"),
        F.concat(F.lit("B "), vid.cast("string")).alias("license_plate"),
        F.when(vid % 3 != 0, F.concat(F.lit("VIN"), vid.cast("string"))).alias("vin"))

    o = t["orders"]
    down = F.col("o_orderkey") % 3 == 0
    payments = o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("B-"), (F.col("o_orderkey") * 100 + 1).cast("string")).alias("booking_id"),
        F.col("o_orderkey").alias("visit_id"),
        F.col("o_orderpriority").alias("payment_method"),
        down.alias("is_down_payment"),
        F.when(down, 30).otherwise(0).alias("down_payment_percent"),
        F.when(down, F.round(F.col("o_totalprice").cast("decimal(12,2)") * F.lit(0.3).cast("decimal(2,1)"), 2))
        .otherwise(0).cast("decimal(12,2)").alias("down_payment_amount"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved")
        .otherwise("rejected").alias("payment_status"),
        F.col("o_orderdate").alias("payment_date"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", F.timestamp_add("DAY", (F.col("o_orderkey") % 30).cast("int"), F.col("o_orderdate")))
        .alias("updated_at"),
    )

    testimonials = jobs.where(done & (F.col("l_linenumber") <= 5) & (F.col("l_discount") >= 0.05)).select(
        F.col("job_key").alias("id"), F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("service_id"),
        F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")).alias("mechanic_id"),
        F.col("l_linenumber").alias("rating"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_tax") < 0.06).alias("approved"), (F.col("l_tax") == 0).alias("featured"))

    availability = (s.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("dow"))
                    .where((F.col("s_suppkey") + F.col("dow")) % 4 != 0)
                    .select(F.col("s_suppkey").alias("mechanic_id"), F.col("dow").alias("day_of_week"),
                            F.lit(480).alias("start_min"), F.lit(1020).alias("end_min")))

    start = F.lit(480) + (F.col("l_linenumber") - 1) * 90
    tasks = jobs.where(~F.col("status").isin("pending", "confirmed")).select(
        F.col("job_key").alias("id"), job_id.alias("booking_id"),
        F.col("l_suppkey").alias("mechanic_id"), "status",
        start.alias("start_min"), F.when(done, start + 60).alias("end_min"))

    notes = jobs.where((F.col("l_quantity") > 40) & (F.col("status") != "pending")).select(
        F.col("job_key").alias("id"), job_id.alias("booking_id"),
        F.col("l_suppkey").alias("mechanic_id"),
        F.concat(F.lit("note "), F.col("l_linenumber").cast("string")).alias("note"),
        F.col("l_shipdate").cast("date").alias("date"), F.lit("pending").alias("status"))

    messages = t["conversations"].select(
        F.col("conv_id").alias("customer_id"), "turn",
        F.when(F.col("role") == "user", "incoming").when(F.col("role") == "assistant", "outgoing").otherwise("notice").alias("type"),
        (F.col("turn") < 4).alias("is_read"), F.col("text").alias("message"),
        F.when(F.col("role") == "assistant", F.lit(2000000) + (F.col("conv_id") + F.col("turn")) % 7).alias("staff_id"))
    # a thread is about its customer's first visit; threads of nobody and notices are about none
    first = t["orders"].groupBy(F.col("o_custkey").alias("_c")).agg(F.min("o_orderkey").alias("_o"))
    messages = messages.join(first, F.col("customer_id") == F.col("_c"), "left").withColumn(
        "booking_id", F.when(F.col("type") != "notice", F.concat(F.lit("B-"), (F.col("_o") * 100 + 1).cast("string")))).drop("_c", "_o")

    activity = t["events"].select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"),
        F.col("props").alias("detail"), F.col("ts").alias("created_at"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat_ws(".", F.lit("10.0"), F.col("user_id") % 256, F.col("event_id") % 256).alias("ip_address"))

    frames = dict(bookings=bookings, services=services, users=users, customers=customers,
                  mechanics=mechanics, vehicles=vehicles, payments=payments,
                  testimonials=testimonials, mechanic_availability=availability,
                  mechanic_tasks=tasks, field_notes=notes, customer_messages=messages,
                  activity_log=activity)
    return Garage(**{k: conform(v, k) for k, v in frames.items()})


# The same binding as DuckDB SQL (oracle side).  Columns the Spark side fills
# with typed NULLs through ``conform`` are NULL here as well.
BINDING_SQL = """
job0 AS (
  SELECT l.*, o_custkey, o_orderpriority, o_totalprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'pending'
         WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'confirmed'
         WHEN l_linestatus = 'O' THEN 'in-progress'
         WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'completed' END AS status
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
bookings AS (
  SELECT concat('B-', CAST(l_orderkey * 100 + seq AS VARCHAR)) AS id,
    l_orderkey AS visit_id, o_custkey AS customer_id, l_partkey AS service_id,
    CASE WHEN status <> 'pending' THEN l_suppkey END AS mechanic_id,
    o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS vehicle_id,
    CAST(l_shipdate AS DATE) AS booking_date, 480 + (l_linenumber - 1) * 90 AS start_min, status,
    CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS customer_name,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS total_price,
    CASE WHEN status = 'completed' AND l_linenumber <= 5 THEN l_linenumber END AS rating,
    CASE WHEN status = 'completed' THEN l_shipdate END AS started_at,
    CASE WHEN status = 'completed' THEN l_shipdate + INTERVAL '1' HOUR * CAST(l_quantity AS INT) END AS completed_at,
    CAST(NULL AS BIGINT) AS created_by
  FROM job0),
services AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS description, p_type AS category,
    CAST(p_retailprice AS DECIMAL(12,2)) AS price,
    p_size + 15 AS estimated_time, p_size > 5 AS in_stock, p_brand = 'Brand#2' AS featured, p_size AS stock FROM part),
users AS (
  SELECT 1000000 + c_custkey AS id, c_name AS name, concat(lower(c_name), '@example.com') AS email, 'customer' AS role,
    CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status FROM customer
  UNION ALL
  SELECT 2000000 + s_suppkey, s_name, concat(lower(s_name), '@example.com'), 'mechanic',
    CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END FROM supplier),
customers AS (SELECT c_custkey AS id, 1000000 + c_custkey AS user_id, CAST(NULL AS VARCHAR) AS phone,
    c_mktsegment AS address, CAST(NULL AS BIGINT) AS total_bookings FROM customer),
mechanics AS (SELECT s_suppkey AS id, 2000000 + s_suppkey AS user_id, n_name AS specialization,
    CAST(s_suppkey % 20 AS INT) AS experience, CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS DOUBLE) AS rating
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
vehicles AS (
  SELECT id, CASE WHEN id % 97 <> 0 THEN customer_id END AS customer_id, make, model, CAST(1990 + id % 30 AS INT) AS year,
    concat('B ', CAST(id AS VARCHAR)) AS license_plate,
    CASE WHEN id % 3 <> 0 THEN concat('VIN', CAST(id AS VARCHAR)) END AS vin, CAST(NULL AS VARCHAR) AS color
  FROM (SELECT DISTINCT o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS id, o_custkey AS customer_id,
          n_name AS make, substr(o_orderpriority, 3) AS model
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) v),
payments AS (
  SELECT o_orderkey AS id, concat('B-', CAST(o_orderkey * 100 + 1 AS VARCHAR)) AS booking_id,
    o_orderkey AS visit_id, o_orderpriority AS payment_method, o_orderkey % 3 = 0 AS is_down_payment,
    CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE 0 END AS down_payment_percent,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN round(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.3 AS DECIMAL(2,1)), 2)
         ELSE 0 END AS DECIMAL(12,2)) AS down_payment_amount,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS payment_status,
    CAST(NULL AS VARCHAR) AS admin_notes, o_orderdate AS payment_date, o_orderdate AS created_at,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 30 AS INT) END AS updated_at FROM orders),
testimonials AS (
  SELECT l_orderkey * 100 + seq AS id, o_custkey AS customer_id, l_partkey AS service_id,
    CASE WHEN l_linenumber <> 2 THEN l_suppkey END AS mechanic_id, l_linenumber AS rating,
    CAST(NULL AS VARCHAR) AS comment,
    CAST(l_shipdate AS DATE) AS date, l_tax < 0.06 AS approved, l_tax = 0 AS featured
  FROM job0 WHERE status = 'completed' AND l_linenumber <= 5 AND l_discount >= 0.05),
mechanic_availability AS (
  SELECT s_suppkey AS mechanic_id, CAST(d.dow AS INT) AS day_of_week, 480 AS start_min, 1020 AS end_min
  FROM supplier, (SELECT unnest(range(1, 6)) AS dow) d
  WHERE (s_suppkey + d.dow) % 4 <> 0),
mechanic_tasks AS (
  SELECT l_orderkey * 100 + seq AS id, concat('B-', CAST(l_orderkey * 100 + seq AS VARCHAR)) AS booking_id,
    l_suppkey AS mechanic_id, status, 480 + (l_linenumber - 1) * 90 AS start_min,
    CASE WHEN status = 'completed' THEN 480 + (l_linenumber - 1) * 90 + 60 END AS end_min
  FROM job0 WHERE status NOT IN ('pending', 'confirmed')),
field_notes AS (
  SELECT l_orderkey * 100 + seq AS id, concat('B-', CAST(l_orderkey * 100 + seq AS VARCHAR)) AS booking_id,
    l_suppkey AS mechanic_id, concat('note ', CAST(l_linenumber AS VARCHAR)) AS note, CAST(l_shipdate AS DATE) AS date,
    CAST(NULL AS VARCHAR) AS parts_needed, 'pending' AS status
  FROM job0 WHERE l_quantity > 40 AND status <> 'pending'),
customer_messages AS (
  SELECT conv_id AS customer_id, turn, CASE role WHEN 'user' THEN 'incoming' WHEN 'assistant' THEN 'outgoing' ELSE 'notice' END AS type,
    turn < 4 AS is_read, text AS message, CASE WHEN role = 'assistant' THEN 2000000 + (conv_id + turn) % 7 END AS staff_id,
    CASE WHEN role IN ('user', 'assistant') THEN concat('B-', CAST(o.first_order * 100 + 1 AS VARCHAR)) END AS booking_id
  FROM conversations LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey) o ON conv_id = o.o_custkey),
activity_log AS (
  SELECT event_id AS id, user_id, event_type AS action, props AS detail, ts AS created_at, event_type <> 'error' AS ok,
    concat('10.0.', CAST(user_id % 256 AS VARCHAR), '.', CAST(event_id % 256 AS VARCHAR)) AS ip_address FROM events)
"""


def with_binding(query: str) -> str:
    """Prefix an oracle query with the binding CTEs.

    ``query`` may start with its own ``WITH`` list; it is merged.
    """
    body = query.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + BINDING_SQL.strip() + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + BINDING_SQL.strip() + ",\n" + body[4:].lstrip()
    return "WITH " + BINDING_SQL.strip() + "\n" + body
