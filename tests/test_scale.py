"""Work per task stays bounded: partitions follow the rows, and no sort is done twice."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from wrenchflow import session
from wrenchflow.operators.changes import number_rows
from wrenchflow.operators.ordered import dealt, first_come, looked_up
from wrenchflow.plans import catalog
from wrenchflow.session import stored
from wrenchflow.sources import binding

LINE = ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")


def _tables(spark):
    lines = spark.range(600).selectExpr(
        "nullif(id % 40, 39) as l_orderkey", "cast(id % 7 as int) as l_linenumber", "id % 11 as l_partkey", "id % 5 as l_suppkey",
        "timestamp_ntz'2001-01-01 00:00:00' as l_shipdate", "cast(id as double) as l_quantity", "cast(1 as double) as l_extendedprice",
        "cast(0 as double) as l_discount", "cast(0 as double) as l_tax", "if(id % 2 = 0, 'R', 'N') as l_returnflag", "'O' as l_linestatus")
    orders = spark.range(45).selectExpr("nullif(id % 35, 34) as o_orderkey", "id % 6 as o_custkey", "'3-MEDIUM' as o_orderpriority")
    return {"lineitem": spark.createDataFrame(lines.collect(), LINE), "orders": orders}


def test_jobs_have_a_partition_per_so_many_lines_and_the_numbers_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 60)
    t = _tables(spark)
    assert binding._jobs(t).rdd.getNumPartitions() >= 10
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
                                                 "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    plain = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).withColumn("n", F.row_number().over(w))
    want = Counter((r.l_quantity, r.l_orderkey * 100 + r.n) for r in plain.collect())
    assert Counter((r.l_quantity, r.job_key) for r in binding._jobs(t).collect()) == want


def test_lines_are_sorted_once_for_their_number_and_their_order(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = binding._jobs(binding.driver_tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Sort [l_orderkey") == 1


def test_job_rows_are_written_once_for_all_their_tables(spark, tmp_path, monkeypatch):
    bound = []
    real = binding._jobs
    monkeypatch.setattr(binding, "_jobs", lambda t: bound.append(1) or real(t))
    monkeypatch.setattr(catalog, "_GARAGES", {})
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: str(tmp_path / "g"))
    g = catalog.garage_for(spark, "/root/testdata/sf0.001")
    assert not (tmp_path / "g").exists()
    assert g.users.count() and not (tmp_path / "g" / "jobs").exists()
    tables = [g.bookings, g.mechanic_tasks, g.testimonials, g.field_notes]
    assert (tmp_path / "g" / "jobs").exists() and len(bound) == 2
    assert tables[0].count() == 6000


def _largest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_null_and_hot_keys_are_looked_up_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = stored(spark.range(3000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else concat('k', id % 500) end as k"))
    table = spark.range(400).selectExpr("if(id = 0, 'hot', concat('k', id)) as t", "id as v")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = looked_up(rows, "id", "k", table, "t")
        assert _largest(out) < 300
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    plain = rows.join(table, F.col("k") == F.col("t"), "left")
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, plain.collect()))


def test_first_come_in_many_tasks_equals_the_replay(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "hot", f"a{i % 90}", f"a{i % 400}"]), rng.choice([None, None, "also", f"b{i % 150}"])) for i in range(900)]
    taken, want = (set(), set()), {}
    for i, *keys in rows:
        want[i] = all(k is None or k not in t for k, t in zip(keys, taken))
        for k, t in zip(keys, taken):
            if want[i]:
                t.add(k)
    for rounds in (1, 4):
        got = first_come(spark.createDataFrame(rows, "n long, a string, b string"), "n", ["a", "b"], rounds).collect()
        assert len(got) == len(rows) and {r.n: r.accepted for r in got} == want


def test_numbered_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = spark.range(2000).selectExpr("(id * 7) % 2000 as k", "id % 3 as v")
    out = number_rows(rows, ["k"])
    assert [r.row_no for r in out.orderBy("k").collect()] == list(range(1, 2001))
    assert dealt(out, "v", ["k"]).select("_p").distinct().count() >= 15
