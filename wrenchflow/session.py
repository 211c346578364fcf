"""Spark session defaults for wrenchflow jobs.

The settings below are the ones the operators rely on:

* AQE on, with partition coalescing and skew-join splitting: a hot key
  (one mechanic, one service, one day holding a third of all bookings) is
  split at runtime instead of landing in one reducer.
* Broadcast joins only through Spark's own size check
  (``spark.sql.autoBroadcastJoinThreshold``); the library never hints
  ``broadcast()`` on a table whose size grows with the data.
* Session time zone UTC so date casts of timestamps are stable.
"""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wrenchflow") -> SparkSession:
    """Return (or create) a session with the library defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``DataFrame.checkpoint``) and for scratch tables.

    Reads ``spark.checkpoint.dir`` from the session, which a cluster sets to
    shared storage; without it a session on a cluster is refused, since its
    executors have no common local disk.  A local session (tests) uses a
    new folder below the JVM's temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        configured = f"{spark._jvm.System.getProperty('java.io.tmpdir')}/wrenchflow-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # this run's own folder goes with it
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


#: Rows that a task sorts or writes at a time, a small part of its memory; and so many that a task is worth its start.
TASK_ROWS, LEAST_TASK_ROWS = 500_000, 50_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """A number of partitions that follows ``rows``, so that no task's rows grow with the tables."""
    small = min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_TASK_ROWS))
    return max(1, small, -(-rows // TASK_ROWS))


#: Spark's switch to remove a statement's shuffle files when it ends, instead of when the JVM collects their plan.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of statements run inside go as soon as each of them ends; what they wrote is all that is kept."""
    before = spark.conf.get(_REMOVE_SHUFFLES, "false")
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` in well compressed columns and read back; its shuffle files go with the write."""
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back: fixed like a checkpoint, but in compressed
    columns, so that later steps read only those they use and rows are counted from the files' footers.

    ``instead_of``: stored frames that nobody reads any more once ``df`` is written; their files go."""
    path = scratch_path(df.sparkSession, f"kept/{uuid.uuid4().hex}")
    out = written(df, path)
    out._kept_at = path
    dropped(*instead_of)
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove the files of frames that ``stored`` returned; what was made of them and not yet run can't be run any more."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
