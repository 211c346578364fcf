"""Sinks (S3-S6): materialised stats, report and audit tables.

All writes go below a caller-given folder; the defaults derive from the
session's shared ``spark.checkpoint.dir`` (never a machine-local temp
folder on a cluster).  Each sink returns the read-back of what it wrote,
so the result is served from the written table, not from the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchflow.session import scratch_path


def _target(spark: SparkSession, path: str | None, name: str) -> str:
    return path or scratch_path(spark, f"tables/{name}")


def refresh_stats_table(stats: DataFrame, path: str | None = None) -> DataFrame:
    """S3: recompute the dashboard stats table (overwrite) and read it back."""
    spark = stats.sparkSession
    target = _target(spark, path, "dashboard_stats")
    stats.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _append(rows: DataFrame, target: str, partition: list[str]) -> DataFrame:
    """Append ``rows`` under a run id of their own and read exactly that run's rows back."""
    run = uuid.uuid4().hex
    rows.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy(*partition, "run_id").parquet(target)
    written = rows.sparkSession.read.parquet(target).where(F.col("run_id") == run)
    return written.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])


def append_report(report: DataFrame, path: str | None = None) -> DataFrame:
    """Append report rows to ``reports`` partitioned by report_type and run; return this run's rows.

    The report is computed once; its NULLs (a period without bookings) come back as NULLs.
    """
    return _append(report, _target(report.sparkSession, path, "reports"), ["report_type"])


def append_audit_log(audit: DataFrame, path: str | None = None) -> DataFrame:
    """Append audit rows (action, table, record id, old/new JSON); return this run's rows."""
    return _append(audit, _target(audit.sparkSession, path, "audit_logs"), [])


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """A new table version (batch operators' output) written whole, then read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
