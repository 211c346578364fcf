"""What came before, per key, without gathering a key: carried scans, components, first-come choice.

``dealt`` range-partitions rows by (key, order), so that a key holding a third of
all rows lies in many tasks; ``running`` gives every row the first or last value of
its key so far: within its partition by a window, across partitions by a small
table of carries, one row per partition and key.

``components`` joins linked nodes; ``first_come`` accepts rows in order unless an
earlier accepted row holds one of their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchflow import session
from wrenchflow.session import checkpoint_dir, partitions_for, stored


@dataclass(frozen=True)
class Running:
    """The first (or last) non-null ``value`` of the key up to a row, with or without the row itself."""

    value: Column
    last: bool = False
    inclusive: bool = True


def dealt(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by (key, order), with the partition's number in ``_p``.

    The bounds come from sampling, so the rows are written once: all
    later reads see the same partitions, whose number follows the rows.
    """
    n = partitions or partitions_for(df.sparkSession, df.count())
    return stored(df.repartitionByRange(n, key, *order).withColumn("_p", F.spark_partition_id()))


def running(rows: DataFrame, key: str, order: list[str], wanted: dict[str, Running]) -> DataFrame:
    """Dealt ``rows`` with a column per wanted value; ``order`` has no ties within a key."""
    names = list(wanted)
    # dealt once for the window and the join by a hash that is never null; keys themselves are compared besides
    n = partitions_for(rows.sparkSession, rows.count())
    rows = rows.select("*", F.xxhash64(key).alias("_kh"), *[wanted[w].value.alias(f"_v_{w}") for w in names])
    inside = Window.partitionBy("_p", "_kh", key).orderBy(*order)
    across = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends, carried, local, out = [], [], [], []
    for w in names:
        pick, held, value = wanted[w], f"_v_{w}", F.col(f"_v_{w}")
        stop = Window.currentRow if pick.inclusive else -1
        frame = inside.rowsBetween(Window.unboundedPreceding, stop)
        chosen, best = (F.last, F.max) if pick.last else (F.first, F.min)
        local.append(chosen(held, ignorenulls=True).over(frame).alias(f"_l_{w}"))
        ends.append(best(F.when(value.isNotNull(), F.struct(*order, value.alias("_value")))).alias(f"_e_{w}"))
        carried.append(chosen(F.col(f"_e_{w}._value"), ignorenulls=True).over(across).alias(f"_c_{w}"))
        sides = [F.col(f"_l_{w}"), F.col(f"_c_{w}")]
        out.append(F.coalesce(*(sides if pick.last else sides[::-1])).alias(w))
    carry = (rows.groupBy("_p", key).agg(*ends).select(F.col("_p").alias("_cp"), F.xxhash64(key).alias("_ch"), F.col(key).alias("_ck"), *carried)
             .repartition(n, "_cp", "_ch"))
    own = [c for c in rows.columns if c not in {"_kh", *(f"_v_{w}" for w in names)}]
    same = (F.col(key) == F.col("_ck")) | (F.col(key).isNull() & F.col("_ck").isNull())
    return (rows.repartition(n, "_p", "_kh").select("*", *local)
            .join(carry, (F.col("_p") == F.col("_cp")) & (F.col("_kh") == F.col("_ch")) & same, "left")
            .select(*own, *out))


def within_tasks(rows: DataFrame, key: str, order: list[str], wanted: dict[str, Running]) -> DataFrame:
    """``running`` over rows of which no key has more than a task's rows: one shuffle by key; a null key is no key."""
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    rows = rows if "_alone" in rows.columns else rows.withColumn("_alone", alone)
    w = Window.partitionBy(key, "_alone").orderBy(*order)
    out = []
    for name, pick in wanted.items():
        frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if pick.inclusive else -1)
        out.append((F.last if pick.last else F.first)(pick.value, ignorenulls=True).over(frame).alias(name))
    return rows.select("*", *out)


def carried(rows: DataFrame, key: str, order: list[str], scans: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """``scans(rows, scan)`` of stored ``rows``, where ``scan(rows, key, order, wanted)`` adds what came before.

    Keys of at most a task's rows are scanned in one shuffle by key; hot ones are dealt by (key, order) and their state carried from
    range to range (``running``).
    """
    hot = hot_keys(rows, key)
    if hot.isEmpty():
        return scans(rows, within_tasks).drop("_alone")
    met = F.col(key) == F.col("_hk")
    few, many = rows.join(F.broadcast(hot), met, "left_anti"), rows.join(F.broadcast(hot), met, "left_semi")
    return scans(few, within_tasks).drop("_alone").unionByName(scans(dealt(many, key, order), running).drop("_p"))


def place_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row among its key's rows in ``order``; equal rows in any order.

    Rows are range-partitioned by (key, order, an arbitrary last key), so a hot key lies in
    many tasks; a row's place is its number within its partition plus the key's
    rows in earlier ones (one row per partition and key).
    """
    held = stored(df.withColumn("_tie", F.monotonically_increasing_id()))
    n = partitions_for(df.sparkSession, held.count())
    rows = stored(held.repartitionByRange(n, *keys, *order, "_tie").withColumn("_p", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order, "_tie"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("_p", *keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
              .select(F.col("_p").alias("_bp"), *[F.col(k).alias(f"_b_{k}") for k in keys], "_before"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys], F.col("_p") == F.col("_bp"))
    return (rows.withColumn("_nth", within).join(before, same).withColumn(out, F.col("_before") + F.col("_nth") - 1)
            .select(*df.columns, out))


def _fixed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(u, v)``; the root is the least node that it reaches.

    Every round links each node to the least label around it and then jumps to that
    label's own label, so long chains shrink by halves; a hub's rows meet
    only in grouped minima.  Ends when no label moves.
    """
    both = _fixed(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node")
    labels = _fixed(labels)
    while True:
        around = (both.join(labels, both.v == labels.node).groupBy(both.u).agg(F.min("root").alias("near")))
        hooked = labels.join(around, labels.node == around.u).select("node", "root", F.least("root", "near").alias("near"))
        # the label's node hears of the better label too: whole trees hook, not single nodes
        lifted = hooked.groupBy("root").agg(F.min("near").alias("low")).withColumnRenamed("root", "hub")
        nxt = (hooked.join(lifted, hooked.near == lifted.hub, "left")
               .select("node", F.col("root").alias("was"), F.least("near", F.coalesce("low", "near")).alias("root")))
        nxt = _fixed(nxt)
        labels = nxt.select("node", "root")
        if nxt.where("root <> was").isEmpty():
            return labels


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """``(_hk, _hc)``: keys with more rows than a task should have, and over how many tasks they go.

    Only keys of a bucket with so many rows can be hot, so in most tables no key moves to be counted.
    """
    some, bucket = rows.where(F.col(key).isNotNull()), F.pmod(F.xxhash64(key), F.lit(1 << 16))
    full = some.groupBy(bucket.alias("_hb")).agg(F.count("*").alias("_hn")).where(F.col("_hn") > session.TASK_ROWS).select("_hb")
    some = some.join(F.broadcast(full), bucket == F.col("_hb"), "left_semi")
    n = some.groupBy(F.col(key).alias("_hk")).agg(F.count("*").alias("_hn"))
    return stored(n.where(F.col("_hn") > session.TASK_ROWS).select("_hk", F.ceil(F.col("_hn") / session.TASK_ROWS).cast("long").alias("_hc")))


def looked_up(rows: DataFrame, row: str, key: str, table: DataFrame, table_key: str, hot: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` with ``table``, whose ``table_key`` is unique.

    Null keys, which meet nothing, are dealt out by ``row`` (a number), and hot ones over several tasks with a
    copy of their table row each, so no task has more than a bounded number of rows of one key.  ``hot``:
    ``hot_keys`` of these or more rows; there is at most one per ``TASK_ROWS`` rows, which makes it safe to broadcast.
    """
    count = rows.count()
    if count <= session.TASK_ROWS:
        return rows.join(table, F.col(key) == F.col(table_key), "left")
    n, hot = partitions_for(rows.sparkSession, count), F.broadcast(hot if hot is not None else hot_keys(rows, key))
    salt = F.when(F.col(key).isNull(), F.col(row)).otherwise(F.coalesce(F.pmod(F.col(row), F.col("_hc")), F.lit(0))).cast("long")
    left = rows.join(hot, F.col(key) == F.col("_hk"), "left").withColumn("_s", salt).drop("_hk", "_hc").repartition(n, key, "_s")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_hc", F.lit(1).cast("long")) - 1)
    right = (table.join(hot, F.col(table_key) == F.col("_hk"), "left").withColumn("_z", F.explode(copies)).drop("_hk", "_hc")
             .repartition(n, table_key, "_z"))
    return left.join(right, (F.col(key) == F.col(table_key)) & (F.col("_s") == F.col("_z")), "left").drop("_s", "_z")


def joined_by(rows: DataFrame, row: str, more: DataFrame, other: str) -> DataFrame:
    """Inner join of stored ``rows`` by their number with what was found about them, so many rows a task."""
    n = partitions_for(rows.sparkSession, rows.count())
    return rows.repartition(n, row).join(more.repartition(n, other), F.col(row) == F.col(other))


def first_come(rows: DataFrame, row: str, keys: list[str], rounds: int = 4, keep: list[str] | None = None, fixed: bool = False) -> DataFrame:
    """``(row, *keep, accepted)``, stored: rows in order of ``row``, unless an earlier accepted row holds one of their keys.

    ``row`` is unique; a null key conflicts with nothing; ``keep`` are keys to be shown, ``fixed`` rows are read from stored
    ones already.  A rejected row takes nothing,
    so a later row may have its keys.  Each round accepts the rows that come first
    among the undecided ones in all their keys, and rejects those that share a
    key with an accepted row: a key that a third of all rows ask for is settled by one
    aggregate and one join that deals it over tasks.  What is left after ``rounds`` (long chains) is replayed in
    order, a component of conflicting rows at a time, as a stream that holds one
    component's taken keys.
    """
    shown, files = [row, *(keep or [])], []

    def held(df: DataFrame, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
        files.append(out := stored(df, instead_of))
        for gone in instead_of:
            files.remove(gone)
        return out

    left = rows.select(row, *keys) if fixed else held(rows.select(row, *keys))
    large = left.count() > session.TASK_ROWS
    hot = [hot_keys(left, k) if large else None for k in keys]
    decided = []
    for _ in range(rounds):
        count = left.count()
        if not count:
            break
        n = partitions_for(left.sparkSession, count)
        # the first row of each key has a vote from it; a row needs one of each key that it has
        firsts = [left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(row).alias("_w")).select("_w") for k in keys]
        votes = reduce(DataFrame.union, firsts).repartition(n, "_w").groupBy("_w").agg(F.count("*").alias("_votes"))
        needed = reduce(Column.__add__, [F.col(k).isNotNull().cast("long") for k in keys])
        judged = held(left.repartition(n, row).join(votes, F.col(row) == F.col("_w"), "left").select(
            row, *keys, (F.coalesce("_votes", F.lit(0)) == needed).alias("_first")))
        taken, before = judged.where("_first"), ()
        rest = judged.where("not _first").select(row, *keys, F.lit(False).alias("_lost"))
        for i, k in enumerate(keys):
            holders = taken.where(F.col(k).isNotNull()).select(F.col(k).alias("_t"))
            met = looked_up(rest, row, k, holders, "_t", hot[i])
            rest = held(met.select(row, *keys, (F.col("_lost") | F.col("_t").isNotNull()).alias("_lost")), before)
            before = (rest,)
        decided += [taken.select(*shown, F.lit(True).alias("accepted")), rest.where("_lost").select(*shown, F.lit(False).alias("accepted"))]
        left = rest.where("not _lost").drop("_lost")
    replayed = _replayed(left, row, keys)
    if keep:
        replayed = left.select(*shown).join(replayed, row).select(*shown, "accepted")
    return stored(reduce(DataFrame.union, [*decided, replayed]), tuple(files))


def _replayed(left: DataFrame, row: str, keys: list[str]) -> DataFrame:
    if left.isEmpty():
        return left.select(row, F.lit(True).alias("accepted"))
    held = [left.where(F.col(k).isNotNull()).select(F.concat(F.lit("r"), F.col(row).cast("string")).alias("u"),
                                                    F.concat(F.lit(f"{i} "), F.col(k).cast("string")).alias("v"))
            for i, k in enumerate(keys)]
    roots = components(reduce(DataFrame.union, held))
    joined = left.join(roots, F.concat(F.lit("r"), F.col(row).cast("string")) == F.col("node"), "left")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = (joined.select(F.coalesce("root", F.lit("")).alias("root"), row, *[F.col(k).cast("string").alias(k) for k in keys])
              .repartition(n, "root").sortWithinPartitions("root", row))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, [set() for _ in keys]
        for batch in batches:
            root, number, *values = (c.to_pylist() for c in batch.columns)
            accepted = []
            for r, own in zip(root, zip(*values)):
                if r != at:
                    at, taken = r, [set() for _ in keys]
                free = all(v is None or v not in t for v, t in zip(own, taken))
                if free:
                    for v, t in zip(own, taken):
                        t.add(v)
                accepted.append(free)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(accepted, pa.bool_())], [row, "accepted"])

    kind = left.schema[row].dataType.simpleString()
    return stream.mapInArrow(replay, f"{row} {kind}, accepted boolean")
