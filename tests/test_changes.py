"""Batch-change building blocks against brute force."""

import pandas as pd
from pyspark.sql import functions as F

from wrenchflow.operators.changes import merge_snapshot, number_rows, partial_update, segmented_last
from wrenchflow.operators.nested import nest_children


def test_segmented_last_hot_key_across_partitions(spark):
    rows = [(1, i, (i if i % 97 == 0 else None)) for i in range(3000)] + [(2, i, None) for i in range(40) if i != 10] + [(2, 10, 7)]
    df = spark.createDataFrame(rows, "k long, seq long, v long")
    got = segmented_last(df, "k", "seq", "v", "prev", partitions=16).toPandas().sort_values(["k", "seq", "v"])
    exp = []
    for k in (1, 2):
        last = None
        for r in got[got.k == k].itertuples():
            exp.append(last)
            if pd.notna(r.v):
                last = r.v
    assert [None if pd.isna(x) else x for x in got.prev] == exp


def test_number_rows_dense_and_ordered(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7 % 2000).alias("k"))
    got = number_rows(df, ["k"], start=100, partitions=8).toPandas().sort_values("k")
    assert got["row_no"].tolist() == list(range(101, 2101))


def test_partial_update_presence_not_null(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, name string, stock int")
    patches = spark.createDataFrame(
        [(1, 1, None, 5, ["stock"]),          # id 1: stock supplied, name absent
         (2, 1, None, None, ["name"]),        # id 1: name explicitly set to NULL (present)
         (1, 2, "q", None, ["name"]), (2, 2, "z", None, ["name"])],   # id 2: last name patch wins
        "patch_seq int, id long, name string, stock int, fields array<string>")
    got = {r.id: (r.name, r.stock) for r in partial_update(old, patches).collect()}
    assert got == {1: (None, 5), 2: ("z", 20)}


def test_merge_snapshot_keeps_untouched(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    new = spark.createDataFrame([(2, "w")], "id long, v string")
    assert sorted(merge_snapshot(old, new, "id").collect()) == sorted([(1, "x"), (2, "w")])


def test_documents_are_ordered_pages_at_every_size(spark):
    import datetime as dt
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(4)]
    rows = [(1, days[i % 4] if i % 9 else None, i, f"n{i % 7}") for i in range(103)] + [(2, days[0], 5, "x"), (3, None, None, None)]
    kids = spark.createDataFrame(rows, "parent long, d date, c long, s string")
    for fields in (["c", "d"], ["d", "c"], ["s", "c"]):
        for desc in (False, True):
            whole = {r.parent: r.kids for r in nest_children(kids, "parent", fields, "kids", desc, part_rows=1000).collect()}
            pages = {}
            for r in nest_children(kids, "parent", fields, "kids", desc, part_rows=10).orderBy("parent", "part").collect():
                assert len(r.kids) <= 10 and r.part == len(pages.get(r.parent, [])) // 10
                pages.setdefault(r.parent, []).extend(r.kids)
            assert pages == whole, (fields, desc)


def test_a_parent_of_many_children_has_pages_of_the_same_meaning(spark):
    from pyspark.sql import functions as F
    kids = spark.range(25_000).select(F.lit(7).alias("parent"), F.col("id").alias("c"))
    got = nest_children(kids, "parent", ["c"], "kids", descending=True).orderBy("part").collect()
    assert [(r.part, len(r.kids), r.kids[0].c) for r in got] == [(0, 10000, 24999), (1, 10000, 14999), (2, 5000, 4999)]
