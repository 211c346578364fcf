"""Skew: one key holding a third of all rows must stay exact and bounded."""

import bisect
import random

from pyspark.sql import functions as F

from wrenchflow.operators.intervals import overlap_counts
from wrenchflow.operators.nested import nest_lists


def test_overlap_counts_with_a_third_of_rows_on_one_key(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(24000):
        key = 0 if i % 3 == 0 else rnd.randint(1, 4000)      # key 0 holds a third of all rows
        s = rnd.randint(0, 1439)
        rows.append((i, key, s, s + rnd.choice([15, 30, 45, 60, 90])))
    df = spark.createDataFrame(rows, "id long, k long, start_min int, end_min int")
    got = {r.id: r.n_overlap for r in overlap_counts(df, df, ["k"]).select("id", "n_overlap").collect()}
    by_key = {}
    for _, k, s, e in rows:
        by_key.setdefault(k, ([], []))
        by_key[k][0].append(s)
        by_key[k][1].append(e)
    for starts, ends in by_key.values():
        starts.sort()
        ends.sort()
    for i, k, s, e in rows:
        starts, ends = by_key[k]
        expected = bisect.bisect_left(starts, e) - bisect.bisect_right(ends, s)   # #{start < e} - #{end <= s}
        assert got[i] == expected


def test_nested_parts_stay_bounded_for_a_hot_parent(spark):
    n = 30000
    kids = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("p"),
                                 F.col("id").alias("c"))
    out = nest_lists("p", [(kids, ["c"], "kids", False)], part_rows=1000)
    sizes = out.select("p", "part", F.size("kids").alias("n"))
    hot = sizes.where(F.col("p") == -1)
    assert hot.agg(F.sum("n")).first()[0] == n // 3                 # every child kept
    assert hot.count() >= 10                                         # spread over many groups
    assert hot.agg(F.max("n")).first()[0] < 2000                     # each part bounded
    assert sizes.agg(F.sum("n")).first()[0] == n
