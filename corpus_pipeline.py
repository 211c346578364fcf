"""Cleaning and packing of a document table in five written stages.

Each stage reads all rows that its predecessor kept; its decisions take effect.
Toxic documents go; repeated lines are taken out of the texts that stay; of each
group of SimHash near-copies one document stays; documents contaminated by the
benchmark go; the rest is packed into sequences.

Null texts stay null through the cleaning stages and count as empty; texts that are
null, empty or have lost all their lines have one fingerprint, so one document of
them stays (of equal ids any one; null ids come last); rows alike in id and text are
one document to line dedup; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wrenchflow.llm import decontaminate, linededup, packing, simhash, toxicity
from wrenchflow.llm.queries import tokenizer_path
from wrenchflow.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; learned from the labels that may be learned from."""
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels), at=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand within 2 edits in an earlier place."""
    return linededup.without_repeated_lines(docs, length_col="n_chars", max_edits=2, chars_per_edit=20)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of SimHashes linked at 3 or fewer bits."""
    return simhash.drop_near_copies(docs, shingle=3, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in 13-word windows of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence of at most 2048 tokens and place in it."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, separator=0)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("SimHash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]

#: Not expressible in SQL: SimHash, the tokenizer and the fitted index have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
