"""The activity-log feed as a Structured Streaming query.

The reference appends (user_id, action, detail, ip) for every successful
action of an authenticated user.  Here raw activity rows land as Parquet
files in a folder; a stateless streaming query filters the successful rows
of known users and appends them to the log table.  ``availableNow`` runs
it as an incremental batch: each run processes only files not seen before
(the checkpoint records them), and a lost executor just re-runs its
micro-batch -- the file sink commits exactly once per batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.model import SCHEMAS
from wrenchflow.session import scratch_path

LOG_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("action", T.StringType()),
                           T.StructField("detail", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
                           T.StructField("ip_address", T.StringType())])


def activity_filter(raw: DataFrame) -> DataFrame:
    """Successful actions of known users, projected to the log's columns."""
    return (raw.where(F.col("ok") & F.col("user_id").isNotNull())
            .select("user_id", "action", "detail", "created_at", "ip_address"))


def activity_log_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                        max_files_per_trigger: int | None = None):
    """Start the feed: ``readStream`` Parquet -> filter -> ``writeStream`` append (availableNow).

    ``max_files_per_trigger`` bounds each micro-batch, so a large backlog is
    worked off in several committed batches instead of one huge one.
    """
    reader = spark.readStream.schema(SCHEMAS["activity_log"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.parquet(source_dir)
    return (activity_filter(raw).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_dir))


def run_activity_feed(raw_batch: DataFrame, base: str | None = None) -> DataFrame:
    """Land ``raw_batch`` as source files, run the feed to completion, return the log table."""
    spark = raw_batch.sparkSession
    root = base or scratch_path(spark, f"activity_feed/{uuid.uuid4().hex}")
    source, sink, ckpt = f"{root}/incoming", f"{root}/log", f"{root}/_checkpoint"
    raw_batch.write.mode("append").parquet(source)
    q = activity_log_stream(spark, source, sink, ckpt)
    q.awaitTermination()
    return spark.read.schema(LOG_SCHEMA).parquet(sink)
