"""Reproducible shuffled shards by a Feistel permutation over global row numbers.

Rows are numbered 0 to N-1 in the order of their id (then text checksum, size and
hash).  A Feistel network over the smallest even number of bits that holds N
permutes the numbers; a result at or above N is put through the network again
(cycle walking) until it falls below N, which keeps it a bijection.  A row's place
q in the shuffled order gives shard ``q mod shards`` and slot ``q div shards``:
both can be computed for any row number without reading a row, and shard counts
differ by at most one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.llm.common import materialise, shuffle_partitions

_ROUNDS = 6


def _round_value(half: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A 64-bit mix of one half and the round's number."""
    with np.errstate(over="ignore"):
        x = half + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The image of row numbers below ``n`` under the seeded permutation of 0 to n-1."""
    bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, width = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.array(numbers, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> width, out[todo] & mask
        for turn in range(_ROUNDS)[::-1 if inverse else 1]:
            if inverse:
                left, right = right ^ (_round_value(left, seed, turn) & mask), left
            else:
                left, right = right, left ^ (_round_value(right, seed, turn) & mask)
        out[todo] = left << width | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def place(number: Column, n: int, seed: int = 0) -> Column:
    @F.pandas_udf(T.LongType())
    def placed(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(np.int64), n, seed))
    return placed(number)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with a global ``row_number`` from 0 in the given order, nulls first.

    Rows are range-partitioned by the order, the partitions' counts give each its
    first number, and rows are numbered within their partition.  Equal rows are
    dealt apart by an arbitrary last key, so many copies don't meet in one task.
    """
    spark = rows.sparkSession
    dealt = materialise(
        rows.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(spark), *order, "__tie")
        .withColumn("__part", F.spark_partition_id()), "numbered")
    before = (dealt.groupBy("__part").count().withColumn("__before", F.sum("count").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__tie"))
    return (dealt.join(before.select("__part", "__before"), "__part")
            .withColumn("row_number", F.col("__before") + within - 1).drop("__part", "__before", "__tie"))


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
           seed: int = 0) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, row_number, shard, slot`` under the law of equal row counts.

    Size is the text's UTF-8 bytes (null: none) plus 8.  Null ids sort first; rows
    alike in id and text have neighbouring numbers, in any order, and so places of
    their own; with fewer rows than shards some shards stay empty; an empty table
    gives no rows.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__hash"))
    rows = materialise(numbered(rows, ["doc_id", "text_crc32", "size", "__hash"]).drop("__hash"), "shard-rows")
    q = rows.withColumn("__q", place(F.col("row_number"), rows.count(), seed))
    return q.select("doc_id", "size", "text_crc32", "row_number", (F.col("__q") % n_shards).cast("int").alias("shard"),
                    F.floor(F.col("__q") / n_shards).cast("long").alias("slot"))

