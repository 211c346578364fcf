"""Quality by hierarchical empirical Bayes, in DataFrame functions.

The document classifier is a naive Bayes over a few binned text ratios, its tables
counted over all labelled rows.  Sites give the prior: a host's share of good
documents is a beta posterior shrunk toward the corpus share, a path's toward its
host's; labelled documents count as seen, all others by the classifier's
probability.  How strongly sparse sites shrink is fitted from the data: the
spread of the sites' shares beyond binomial noise gives the prior's weight
(method of moments).  A document's score adds its own evidence, weighed down to
be calibrated on the labels, to its path's log odds.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.llm.common import materialise

#: Weight of the shrinking prior: never below, never above.
WEIGHT_RANGE = (1.0, 1e6)
#: Bins per ratio: their upper edges.
EDGES = {
    "symbols": [0.002, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32],
    "capitals": [0.005, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64],
    "digits": [0.002, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32],
    "marks": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.16],
    "short_words": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6],
    "word_length": [2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0],
    "distinct_words": [0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9],
    "distinct_lines": [0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.999],
    "log_words": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0],
}


def ratios(text: Column) -> Column:
    """The struct of ratios of a text; an empty text has zeros everywhere."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")

    def from_parts(p: Column) -> Column:
        n, size = F.greatest(F.size(p["words"]), F.lit(1)), F.greatest(F.length(p["t"]), F.lit(1))

        def left(pattern: str) -> Column:
            return F.length(p["t"]) - F.length(F.regexp_replace(p["t"], pattern, ""))

        lines = F.filter(F.split(p["t"], "\n"), lambda x: F.trim(x) != "")
        return F.struct(
            (left(r"[^\p{L}\p{N}\s.,;:!?'\"()-]") / size).alias("symbols"),
            (left(r"\p{Lu}") / size).alias("capitals"), (left(r"\p{N}") / size).alias("digits"),
            (left(r"[.,;:!?]") / size).alias("marks"),
            (F.size(F.filter(p["words"], lambda w: F.length(w) <= 3)) / n).alias("short_words"),
            (F.length(F.array_join(p["words"], "")) / n).alias("word_length"),
            (F.size(F.array_distinct(p["words"])) / n).alias("distinct_words"),
            (F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))).alias("distinct_lines"),
            F.log1p(F.size(p["words"])).alias("log_words"))

    return F.transform(F.array(F.struct(t.alias("t"), words.alias("words"))), from_parts)[0]


def bins(r: Column) -> Column:
    """Array of one bin number per ratio, in the order of EDGES."""
    out = []
    for name, edges in EDGES.items():
        k = F.lit(0)
        for e in edges:
            k = k + (r[name] > e).cast("int")
        out.append(k)
    return F.array(*out)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit_tables(features: DataFrame, smooth: float = 1.0) -> tuple[dict[tuple[int, int], float], float, float]:
    """(log odds per (ratio, bin), prior share of good rows, evidence weight) from ``y`` and ``bins``.

    The tables have a row per ratio and bin, whatever the corpus.  ``weight``
    scales the summed evidence, which naive Bayes overstates as its ratios are
    related: the value of a grid with the least log loss on the same rows.
    """
    seen = features.where("y is not null")
    total = seen.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = float(total.n), float(total.p or 0)
    share = (p + smooth) / (n + 2 * smooth)
    counts = (seen.select("y", F.posexplode("bins").alias("k", "b")).groupBy("k", "b")
              .agg(F.sum("y").alias("a"), F.count("*").alias("c")).collect())
    width = 8 * smooth
    odds = {}
    for r in counts:
        good, bad = (r.a + smooth) / (p + width), (r.c - r.a + smooth) / (n - p + width)
        odds[r.k, r.b] = math.log(good / bad)
    if not n:
        return odds, 0.5, 1.0
    evidence = _evidence(F.col("bins"), odds)
    grid = [0.1, 0.2, 0.3, 0.5, 0.7, 1.0]
    base = math.log(share / (1 - share))

    def loss(w: float) -> Column:
        s = F.least(F.greatest(_sigmoid(F.lit(base) + w * evidence), F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.avg(-F.when(F.col("y") == 1, F.log(s)).otherwise(F.log(1 - s)))

    losses = seen.agg(*[loss(w).alias(f"w{i}") for i, w in enumerate(grid)]).first()
    return odds, share, grid[min(range(len(grid)), key=lambda i: losses[i])]


def _evidence(bin_array: Column, odds: dict[tuple[int, int], float]) -> Column:
    if not odds:
        return F.lit(0.0)
    table = F.create_map(*chain.from_iterable((F.lit(k * 100 + b), F.lit(float(v))) for (k, b), v in sorted(odds.items())))
    return F.aggregate(F.transform(bin_array, lambda b, k: F.coalesce(F.try_element_at(table, k * 100 + b), F.lit(0.0))),
                       F.lit(0.0), lambda s, x: s + x)


def _weight(sites: DataFrame, share: Column, n: str, good: str) -> float:
    """Method of moments: the beta prior's weight from the spread of the sites' shares."""
    usable = sites.where(F.col(n) > 1)
    rate = F.col(good) / F.col(n)
    row = usable.agg(F.sum(F.col(n) * (rate - share) ** 2).alias("spread"), F.sum(share * (1 - share)).alias("noise"),
                     F.sum((F.col(n) - 1) * share * (1 - share)).alias("room")).first()
    if not row.room:
        return WEIGHT_RANGE[1]
    excess = max((row.spread - row.noise) / row.room, 0.0)
    return min(max((1 - excess) / excess if excess > 0 else WEIGHT_RANGE[1], WEIGHT_RANGE[0]), WEIGHT_RANGE[1])


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
            text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: ``doc_id, host, path, doc_score, host_rate, path_rate, score, predicted``.

    ``doc_score`` is the classifier alone, ``score`` with the site as prior.  Null
    texts count as empty, null hosts and paths are sites of their own (named
    ''); of several labels of an id the least holds; rows with repeated ids are
    scored alike; without labels every share is one half.  Sites are summed per
    group with partial sums, so a site with a third of all rows is no hot spot.
    """
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"),
                       F.coalesce(path, F.lit("")).alias("path"), bins(ratios(docs[text_col])).alias("bins"))
    rows = materialise(rows.join(known, "doc_id", "left"), "quality-rows")
    odds, share, weight = fit_tables(rows)
    base = math.log(share / (1 - share))
    rows = rows.withColumn("evidence", weight * _evidence(F.col("bins"), odds))
    rows = rows.withColumn("doc_score", _sigmoid(F.lit(base) + F.col("evidence")))
    seen = F.coalesce(F.col("y").cast("double"), F.col("doc_score"))
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(seen).alias("good")), "quality-paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "quality-hosts")
    total = hosts.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    overall = min(max((total.g + 0.5) / (total.n + 1), 1e-6), 1 - 1e-6) if total.n else 0.5
    m = _weight(hosts, F.lit(overall), "n", "good")
    hosts = hosts.select("host", ((F.col("good") + m * overall) / (F.col("n") + m)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    m = _weight(paths, F.col("host_rate"), "n", "good")
    paths = paths.select("host", "path", "host_rate", ((F.col("good") + m * F.col("host_rate")) / (F.col("n") + m)).alias("path_rate"))
    sites = materialise(paths, "quality-sites")
    rate = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = rows.join(sites, ["host", "path"]).withColumn("score", _sigmoid(_logit(rate) + F.col("evidence")))
    return scored.select("doc_id", "host", "path", "doc_score", "host_rate", "path_rate", "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
