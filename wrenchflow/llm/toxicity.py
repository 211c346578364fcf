"""Toxicity by nearest labelled examples under exact TF-IDF cosine, through a block-max inverted index.

Terms are words.  Every fitted example, toxic or clean, is held with all its terms.  A
term's weight is its idf over the fitted examples times a smooth factor above zero that
rises with what their labels show the term to bear on toxicity; no term is left out.
A query's terms that no example holds count in its norm.

Examples that use the same frequent words stand together, in blocks of ``_BLOCK``.  The
postings of a term are cut by block, and each cut has its largest weight.  A query adds up
these maxima to an upper bound per block, scores the best-bounded blocks through their
postings, and then only those blocks whose bound reaches the k-th cosine so far: all
others are passed over unread, and the k nearest are exact.  They vote with their
cosine as weight.  Votes are calibrated by folds: each example is judged by an index,
term weights included, that has not seen its fold.

Fitting uses at most ``max_fit_rows`` labelled rows, half of them of each label as far as
there are (a hash of the id chooses them), of at most ``max_fit_chars`` characters
together; scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.llm.common import materialise

_LETTERS = re.compile(r"[^\W\d_]+")
#: Examples of a block; blocks scored first; folds of the calibration.
_BLOCK, _FIRST, FOLDS = 32, 2, 5
#: Above the relative error of adding up a few thousand products in double precision.
_ERROR = 1e-11
#: Share of a term's idf that it has whatever the labels say, and rows that the prior counts for.
_FLOOR, _PSEUDO = 0.05, 5.0

_NEIGHBOUR = T.StructType([T.StructField("example", T.StringType()), T.StructField("toxic", T.IntegerType()),
                           T.StructField("cosine", T.DoubleType())])
_RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("vote", T.DoubleType()),
                        T.StructField("terms", T.ArrayType(T.StringType())),
                        T.StructField("evidence", T.ArrayType(_NEIGHBOUR))])


def terms_of(text: str | None) -> dict[str, int]:
    """How often each term stands in the text."""
    return Counter(_LETTERS.findall((text or "").lower()))


def bearing(a: np.ndarray, b: np.ndarray, prior: float) -> np.ndarray:
    """How much a term of ``a`` toxic and ``b`` clean examples bears on the label, smooth and above zero.

    The divergence (in nats) of its rate of toxic examples, drawn to the prior by a
    few rows' weight, from the prior, and a floor for terms that show nothing.
    """
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    rate = (a + _PSEUDO * prior) / (a + b + _PSEUDO)
    return _FLOOR + np.maximum(rate * np.log(rate / prior) + (1 - rate) * np.log((1 - rate) / (1 - prior)), 0.0)


@dataclass
class Examples:
    """The fitted examples as counts: example i has ``terms`` and ``counts`` from starts[i] to starts[i + 1]."""

    vocabulary: list[str]
    names: list[str]
    toxic: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def some(self, kept: np.ndarray) -> "Examples":
        """The examples of these places, in this order."""
        sizes = np.diff(self.starts)[kept]
        at = _spread(self.starts[:-1][kept], sizes)
        return Examples(self.vocabulary, [self.names[i] for i in kept], self.toxic[kept], np.concatenate(([0], np.cumsum(sizes))),
                        self.terms[at], self.counts[at])

    def together(self) -> np.ndarray:
        """An order in which examples with the same most frequent terms are neighbours."""
        df = np.bincount(self.terms, minlength=len(self.vocabulary))
        lead = np.zeros((3, len(self.names)), np.int64)
        for i, (a, b) in enumerate(zip(self.starts.tolist(), self.starts[1:].tolist())):
            best = sorted(range(a, b), key=lambda p: (-self.counts[p] * df[self.terms[p]], self.terms[p]))[:3]
            lead[:len(best), i] = self.terms[best] + 1
        return np.lexsort((np.arange(len(self.names)), lead[2], self.toxic, lead[1], lead[0]))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples and their block-max postings, made where they are first used."""

    examples: Examples
    k: int = 25
    knots: list[tuple[float, float]] = field(default_factory=list)
    passed: int = 0  # blocks whose postings were not read
    read: int = 0

    def __getstate__(self) -> dict:
        return {"examples": self.examples, "k": self.k, "knots": self.knots, "passed": 0, "read": 0}

    def __getattr__(self, name: str):
        if name.startswith("_") or "examples" not in self.__dict__ or "number" in self.__dict__:
            raise AttributeError(name)
        self._prepare()
        return getattr(self, name)

    def _prepare(self) -> None:
        x = self.examples
        n, v = len(x.names), len(x.vocabulary)
        self.number = {t: i for i, t in enumerate(x.vocabulary)}
        self.prior = float(x.toxic.mean()) if n else 0.5
        owner = np.repeat(np.arange(n), np.diff(x.starts))
        toxic = np.bincount(x.terms, x.toxic[owner].astype(float), v) if n else np.zeros(v)
        df = np.bincount(x.terms, minlength=v)
        self.of_term = (np.log((1 + n) / (1 + df)) + 1) * bearing(toxic, df - toxic, self.prior)
        self.unknown = (np.log(1 + n) + 1) * float(bearing(np.zeros(1), np.zeros(1), self.prior)[0])
        weights = (1 + np.log(x.counts)) * self.of_term[x.terms]
        norm = np.sqrt(np.bincount(owner, weights * weights, n)) if n else np.zeros(0)
        # postings by term, then example; cut where term or block changes
        order = np.lexsort((owner, x.terms))
        self.place, self.weight = owner[order].astype(np.int32), weights[order] / norm[owner[order]] if n else weights
        term, block = x.terms[order], self.place // _BLOCK
        new = np.ones(len(order), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.cut = np.flatnonzero(new)
        self.cut_size = np.diff(np.append(self.cut, len(order)))
        self.cut_block = block[self.cut]
        self.cut_max = np.maximum.reduceat(self.weight, self.cut) if len(self.cut) else np.zeros(0)
        self.at = np.searchsorted(term[self.cut], np.arange(v + 1))  # term t's cuts: at[t] to at[t + 1]
        self.n_blocks = -(-n // _BLOCK)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights; unknown ones count in the norm."""
        counts = terms_of(text)
        known = [(self.number[t], c) for t, c in counts.items() if t in self.number]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, n = (np.array(part) for part in zip(*known))
        w = (1 + np.log(n)) * self.of_term[terms]
        rest = 0.0
        if len(known) < len(counts):
            other = 1 + np.log(np.array([c for t, c in counts.items() if t not in self.number], float))
            rest = self.unknown ** 2 * float(other @ other)
        return terms, w / np.sqrt(w @ w + rest)

    def nearest(self, query: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above zero; ties go to the earlier place."""
        terms, weights = query
        if not len(terms):
            return []
        sizes = self.at[terms + 1] - self.at[terms]
        cuts = _spread(self.at[terms], sizes)
        factor = np.repeat(weights, sizes)
        block = self.cut_block[cuts]
        bound = np.bincount(block, factor * self.cut_max[cuts], self.n_blocks)
        best = np.argsort(-bound, kind="stable")
        wanted = np.zeros(self.n_blocks, bool)
        wanted[best[:max(_FIRST, -(-self.k // _BLOCK))]] = True
        sums = self._scored(cuts, factor, wanted[block])
        least = self._kth(sums)
        rest = (bound >= least) & (bound > 0) & ~wanted
        self.read += int((rest | wanted).sum())
        self.passed += self.n_blocks - int((rest | wanted).sum())
        if rest.any():
            sums += self._scored(cuts, factor, rest[block])
            least = self._kth(sums)
        found = np.flatnonzero((sums >= least) & (sums > 0))
        cosines = np.round(sums[found], 12)
        first = np.lexsort((found, -cosines))[:self.k]
        return [(c, i) for c, i in zip(cosines[first].tolist(), found[first].tolist()) if c > 0]

    def _scored(self, cuts: np.ndarray, factor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Cosines through the postings of the chosen cuts only."""
        cuts, factor = cuts[chosen], factor[chosen]
        sizes = self.cut_size[cuts]
        at = _spread(self.cut[cuts], sizes)
        return np.bincount(self.place[at], np.repeat(factor, sizes) * self.weight[at], len(self.examples.names))

    def _kth(self, sums: np.ndarray) -> float:
        if len(sums) <= self.k:
            return 0.0
        return float(np.partition(sums, len(sums) - self.k)[len(sums) - self.k]) * (1 - _ERROR)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Toxic share of the neighbours by cosine, with half a neighbour of the prior; -1 without one."""
        if not near:
            return -1.0
        total = sum(c for c, _ in near)
        return (sum(c * int(self.examples.toxic[i]) for c, i in near) + 0.5 * self.prior) / (total + 0.5)

    def judged(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(self.vector(text))
        return self.vote(near), near

    def shared(self):
        """This index as a broadcast value, made once, which a Python worker reads and prepares once."""
        if "_shared" not in self.__dict__:
            self._shared = SparkSession.active().sparkContext.broadcast(self)
        return self._shared


def calibrated(vote: float, knots: list[tuple[float, float]]) -> float:
    x, y = zip(*knots)
    return float(np.interp(vote, x, y))


def _isotonic(x: list[float], y: list[float], n: list[float]) -> list[tuple[float, float]]:
    """Pool adjacent violators: a rising step per bin as (vote, rate) knots."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    return [(a / c, b / c) for a, b, c in pools]


def fold_votes(examples: Examples, fold: int, k: int, folds: int = FOLDS) -> list[tuple[float, int]]:
    """Vote and label of a fold's examples under an index of the other folds, their term weights included."""
    here = np.arange(len(examples.names)) % folds == fold
    index = Index(examples.some(np.flatnonzero(~here)), k)
    index._prepare()
    out = []
    for i in np.flatnonzero(here).tolist():
        a, b = examples.starts[i], examples.starts[i + 1]
        terms, counts = examples.terms[a:b], examples.counts[a:b]
        w = (1 + np.log(counts)) * index.of_term[terms]
        query = (terms, w / np.sqrt(w @ w)) if len(terms) else (terms, w)
        out.append((index.vote(index.nearest(query)), int(examples.toxic[i])))
    return out


def calibration(votes: list[tuple[float, int]], of_class: tuple[float, float]) -> list[tuple[float, float]]:
    """Knots from votes with labels; ``of_class`` is how many rows a fitted clean and a fitted toxic one stand for."""
    bins: dict[int, list[float]] = {}
    prior = sum(of_class[1] for _, y in votes if y) / max(sum(of_class[y] for _, y in votes), 1e-9)
    for v, y in votes:
        held = bins.setdefault(int(np.floor(v * 20)), [0.0, 0.0, 0.0])
        held[0] += v * of_class[y]
        held[1] += y * of_class[y]
        held[2] += of_class[y]
    rows = [(s / n, (y + 0.5 * prior) / (n + 0.5), n) for _, (s, y, n) in sorted(bins.items())]
    return _isotonic(*(list(c) for c in zip(*rows)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_fit_rows: int = 2_000, max_fit_chars: int = 32_000_000, k: int = 25) -> Index:
    """The example index from the labelled rows given (leave held-out rows out beforehand).

    Rows with a null id or label are ignored; of equal texts one example is made,
    toxic if any is.  Without any usable row every text scores 0.5.
    """
    spark = docs.sparkSession
    usable = (labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
              .where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y")))
    usable = materialise(usable.withColumn("h", F.shiftrightunsigned(F.xxhash64("i"), 1)), "toxicity-labels")
    totals = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # of each label the rows of least hash: those below a bound that about twice as many pass, then in order
    half = max_fit_rows // 2
    low = [usable.where((F.col("y") == y) & (F.col("h") <= min(2 ** 63 * (2 * half + 100) // n, 2 ** 63 - 1))) for y, n in sorted(totals.items())]
    chosen = reduce(DataFrame.unionByName, [x.orderBy("h", "i").limit(half) for x in low], usable.limit(0))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = materialise(  # at most max_fit_rows small rows are broadcast
        texts.join(F.broadcast(chosen), "i").groupBy("t")
        .agg(F.max("y").alias("y"), F.min("i").cast("string").alias("i"), F.min("h").alias("h"))
        .repartition(4 * spark.sparkContext.defaultParallelism, "i"), "toxicity-fit")
    so_far = Window.orderBy("h", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # max_fit_rows rows at most
    kept = (rows.select("i", "h", F.length("t").alias("n")).withColumn("n", F.sum("n").over(so_far))
            .where(F.col("n") <= max_fit_chars).select("i"))

    @F.pandas_udf("terms array<string>, counts array<int>")
    def counted(t: pd.Series) -> pd.DataFrame:
        made = [sorted(terms_of(x).items()) for x in t]
        return pd.DataFrame({"terms": [[w for w, _ in m] for m in made], "counts": [[c for _, c in m] for m in made]})

    held = (rows.join(F.broadcast(kept), "i").select("i", "y", counted("t").alias("c")).select("i", "y", "c.*")
            .toArrow().sort_by("i"))
    if not held.num_rows:
        return Index(Examples([], [], np.zeros(0, int), np.zeros(1, int), np.zeros(0, int), np.zeros(0, int)), k,
                     [(-1.0, 0.5), (1.0, 0.5)])
    terms = held["terms"].combine_chunks()
    coded = terms.flatten().dictionary_encode()
    starts = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))))
    examples = Examples(coded.dictionary.to_pylist(), held["i"].to_pylist(), held["y"].to_numpy().astype(int), starts,
                        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                        held["counts"].combine_chunks().flatten().to_numpy().astype(np.int64))
    examples = examples.some(examples.together())
    shared = spark.sparkContext.broadcast(examples)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold in batch.column(0).to_pylist():
                out = fold_votes(shared.value, fold, k)
                yield pa.RecordBatch.from_pydict({"v": [v for v, _ in out], "y": [y for _, y in out]},
                                                 pa.schema([("v", pa.float64()), ("y", pa.int32())]))

    judged = [(r.v, r.y) for r in spark.range(0, FOLDS, 1, FOLDS).mapInArrow(votes, "v double, y int").collect()]
    shared.unpersist()
    of_class = tuple(totals.get(y, 0) / max(int((examples.toxic == y).sum()), 1) for y in (0, 1))
    return Index(examples, k, calibration(judged, of_class))


def score(text: Column, index: Index) -> Column:
    """The calibrated score alone, as of ``toxicity``."""
    shared, knots = index.shared(), index.knots

    @F.pandas_udf(T.DoubleType())
    def judged(texts: pd.Series) -> pd.Series:
        here = shared.value
        return pd.Series([calibrated(here.judged(t)[0], knots) for t in texts], dtype=float)

    return judged(text)


def toxicity(text: Column, index: Index) -> Column:
    """A struct column: calibrated ``score``, raw ``vote``, the text's ``terms`` that examples hold and its nearest examples.

    Null and empty texts have no term and score like any text without one.
    """
    shared, knots = index.shared(), index.knots

    @F.pandas_udf(_RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        here, rows = shared.value, []
        held = here.examples
        for t in texts:
            vote, near = here.judged(t)
            known = sorted(w for w in terms_of(t) if w in here.number)
            rows.append((calibrated(vote, knots), vote, known, [(held.names[i], int(held.toxic[i]), c) for c, i in near[:5]]))
        return pd.DataFrame(rows, columns=_RESULT.names)

    return judged(text)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5 == 0


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the id as text mod 5 is not 0."""
    return labels.where(~held_out(F.col(id_col)))


def without_toxic(docs: DataFrame, index: Index, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """``docs`` whose score is below ``at``, in all their columns."""
    judged = docs.withColumn("__toxicity", score(docs[text_col], index))
    return judged.where(F.col("__toxicity") < at).drop("__toxicity")
