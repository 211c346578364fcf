"""The activity feed is incremental (a second run only takes new files)."""

import tempfile

from pyspark.sql import functions as F

from wrenchflow.streaming.activity import LOG_SCHEMA, activity_log_stream


def test_activity_feed_incremental(spark, garage):
    root = tempfile.mkdtemp(prefix="wf-stream-")
    src, sink, ckpt = f"{root}/in", f"{root}/log", f"{root}/ckpt"
    log = garage.activity_log
    first = log.where(F.col("id") % 2 == 0)
    second = log.where(F.col("id") % 2 == 1)
    first.write.parquet(src, mode="append")
    activity_log_stream(spark, src, sink, ckpt).awaitTermination()
    n1 = spark.read.schema(LOG_SCHEMA).parquet(sink).count()
    second.write.parquet(src, mode="append")
    activity_log_stream(spark, src, sink, ckpt).awaitTermination()
    n2 = spark.read.schema(LOG_SCHEMA).parquet(sink).count()
    expected = log.where(F.col("ok") & F.col("user_id").isNotNull()).count()
    assert n1 == first.where(F.col("ok") & F.col("user_id").isNotNull()).count()
    assert n2 == expected


def test_activity_feed_bounded_batches(spark, garage):
    root = tempfile.mkdtemp(prefix="wf-stream-")
    src, sink, ckpt = f"{root}/in", f"{root}/log", f"{root}/ckpt"
    garage.activity_log.repartition(4).write.parquet(src)
    q = activity_log_stream(spark, src, sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) >= 2
    expected = garage.activity_log.where(F.col("ok") & F.col("user_id").isNotNull()).count()
    assert spark.read.schema(LOG_SCHEMA).parquet(sink).count() == expected
