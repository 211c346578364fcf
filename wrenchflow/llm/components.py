"""Connected components by alternating large-star and small-star joins.

Every round is two grouped minima and two joins on the edge list; no node's
neighbours are ever gathered in one value, and each round's edges are written to
the shared folder so that lineage stays short.  The loop ends when a round
leaves the edge list as it was; the number of rounds is logarithmic in the
component size in practice and has no cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchflow.llm.common import materialise


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return int(row.n), int(row.h or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node reachable.

    Self edges and repeated edges are ignored; an empty edge list gives no rows.
    Nodes with no edge don't appear: they are their own root.
    """
    edges = materialise(edges.select("u", "v").where("u <> v"), f"{name}-edges")
    mark = _mark(edges)
    while mark[0]:
        edges = materialise(_small_star(_large_star(edges)), f"{name}-star")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
