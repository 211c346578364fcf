"""Table versions: all tables that a batch changes become visible together.

A base folder holds data files per table, version and part, and one manifest per
version: a single small file that names, for every part of every table, the
version whose files hold it.  ``commit`` writes the parts that a batch changes under
the next version, then the manifest; a reader takes the newest manifest, so it sees
either all tables of a commit or none.  Parts without a changed key aren't read
or written.  Bookings are parted by month, other tables by a hash of their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchflow.model import SCHEMAS
from wrenchflow.session import checkpoint_dir
from wrenchflow.sources.tables import Garage, conform

#: Parts of a table that is parted by a hash; key columns of tables without an id.
HASH_PARTS = 16
KEYS = {"mechanic_availability": ["mechanic_id", "day_of_week", "start_min"], "customer_messages": ["customer_id", "turn"]}
_MANIFEST = "table string, part string, version int"


def key_of(table: str) -> list[str]:
    return KEYS.get(table, ["id"])


def part_of(table: str) -> Column:
    if table == "bookings":
        return F.coalesce(F.date_format("booking_date", "yyyy-MM"), F.lit("none"))
    return F.pmod(F.xxhash64(*key_of(table)), F.lit(HASH_PARTS)).cast("string")


def _manifests(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(f"{_MANIFEST}, commit int").parquet(f"{base}/manifest")


def latest(spark: SparkSession, base: str) -> int:
    """The newest committed version; -1 without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return -1
    found = _manifests(spark, base).agg(F.max("commit")).first()[0]
    return -1 if found is None else int(found)


def _parts(spark: SparkSession, base: str, version: int) -> dict[str, dict[str, int]]:
    """Per table the version that holds each part (a row per part: months and hash values)."""
    held: dict[str, dict[str, int]] = {t: {} for t in SCHEMAS}
    if version >= 0:
        for r in _manifests(spark, base).where((F.col("commit") == version) & (F.col("table") != "")).collect():
            held[r.table][r.part] = r.version
    return held


def _read(spark: SparkSession, base: str, table: str, parts: dict[str, int]) -> DataFrame:
    paths = [f"{base}/data/{table}/version={v}/_part={p}" for p, v in sorted(parts.items())]
    return spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])


def load_version(spark: SparkSession, base: str, version: int | None = None) -> Garage:
    """All tables as of a committed version, by default the newest."""
    parts = _parts(spark, base, latest(spark, base) if version is None else version)
    return Garage(**{t: _read(spark, base, t, parts[t]) for t in SCHEMAS})


def commit(spark: SparkSession, base: str, upserts: dict[str, DataFrame], deletes: dict[str, DataFrame] | None = None) -> int:
    """Write changed rows of several tables as the next version and return its number.

    ``upserts`` has whole rows, which replace stored ones of equal key or are new;
    ``deletes`` has keys.  A key stands once.  A commit that fails before its manifest
    leaves the old version as it was; two commits of the same number can't both
    succeed, since a manifest is written only where none stands.
    """
    deletes = deletes or {}
    before = latest(spark, base)
    number, parts = before + 1, _parts(spark, base, before)
    checkpoint_dir(spark)
    for table in sorted(set(upserts) | set(deletes)):
        parts[table] = parts[table] | _write(spark, base, table, number, parts[table], upserts.get(table), deletes.get(table))
        parts[table] = {p: v for p, v in parts[table].items() if v >= 0}
    rows = [("", "", number), *((t, p, v) for t, held in parts.items() for p, v in held.items())]  # the first stands for the commit
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{base}/manifest/commit={number}")
    return number


def _write(spark: SparkSession, base: str, table: str, number: int, held: dict[str, int], new: DataFrame | None,
           gone: DataFrame | None) -> dict[str, int]:
    """Rewrite the touched parts of one table; a part left without rows gets version -1."""
    key, stored = key_of(table), _read(spark, base, table, held)
    new = conform(new, table) if new is not None else spark.createDataFrame([], SCHEMAS[table])
    new = new.withColumn("_part", part_of(table)).checkpoint()
    keys = new.select(*key)
    if gone is not None:
        keys = keys.union(gone.select(*key)).distinct()
    # a changed row leaves its old part, which may be another one
    touched = {r[0] for r in stored.join(keys, key, "left_semi").select(part_of(table)).union(new.select("_part")).distinct().collect()}
    old = _read(spark, base, table, {p: v for p, v in held.items() if p in touched})
    path = f"{base}/data/{table}/version={number}"
    (old.join(keys, key, "left_anti").withColumn("_part", part_of(table)).unionByName(new)
     .repartition("_part", F.pmod(F.xxhash64(*key), F.lit(4))).write.partitionBy("_part").parquet(path))
    if not touched:
        return {}
    left = {r[0] for r in spark.read.schema("_part string").parquet(path).select("_part").distinct().collect()}
    return {p: number if p in left else -1 for p in touched}
