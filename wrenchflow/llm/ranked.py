"""Ranked lexical search by dual trees.

Every document is scored against every item (query) by term weights and saturated
term frequencies; each item keeps its k best.  Items stand in a hierarchy whose
nodes hold, per term, the largest weight of any item below; documents, dealt to
tasks and taken in chunks, stand in a hierarchy whose nodes hold, per term, the
largest frequency part of any document below.  The product of two nodes' maxima
bounds every score between their items and documents.  Where it is below the
weakest k-th score of the node's items so far, the whole batch of pairs is passed
over; equal bounds are not, so ties are kept: the result is exact.

A first pass over the texts counts terms and keeps, per document, its length and
the frequencies of the items' terms; the search reads only these.  Each task hands
on at most k rows per item, which one more ranking joins.

All numbers are whole; products and sums stay below 2^53 and so are exact in
doubles (an item of more terms than ``_EXACT_TERMS`` is added up in 64-bit integers).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchflow.llm.common import materialise, shuffle_partitions

#: ASCII letters and digits, A-Z lower-cased; bytes of other code points stay; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of a chunk and of a leaf; children of a node.
_CHUNK, _LEAF, _FAN = 2048, 32, 4
_ITEM_LEAF = 8
#: Largest product of weight and frequency part is below 42,000 * 10^6; so many of them stay below 2^53.
_EXACT_TERMS = 200_000


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def fractions(tf: np.ndarray, length: int, n_docs: int, total: int) -> np.ndarray:
    """The frequency part of a document's terms, a whole number below 10^6."""
    m = 50 + 50 * length * n_docs // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass
class Items:
    """Queries with their weights, in the order of their hierarchy."""

    names: list
    weights: np.ndarray  # term x item
    levels: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = field(default_factory=list)  # maxima, node of item, children

    @staticmethod
    def of(names: list, rows: list[list[tuple[int, int]]], n_terms: int) -> "Items":
        """Items as (term, weight) lists; likes stand together."""
        exact = max(map(len, rows), default=0) <= _EXACT_TERMS
        weights = np.zeros((n_terms, len(rows)), np.float64 if exact else np.int64)
        for j, row in enumerate(rows):
            for t, w in row:
                weights[t, j] = w
        order = _order(weights.T.astype(np.float64))
        made = Items([names[j] for j in order], np.ascontiguousarray(weights[:, order]))
        size = _ITEM_LEAF
        node = np.arange(len(order)) // size
        while len(order):
            starts = np.unique(node, return_index=True)[1]
            made.levels.append((np.maximum.reduceat(made.weights, starts, axis=1), node, []))
            if len(starts) == 1:
                break
            node = node // _FAN
        made.levels.reverse()
        for (_, upper, children), (_, lower, _) in zip(made.levels, made.levels[1:]):
            children.extend(np.unique(lower[upper == p]) for p in range(upper[-1] + 1))
        return made


def _order(rows: np.ndarray) -> list[int]:
    """An order that keeps likes together: each next row is the one most alike the last."""
    if not len(rows):
        return []
    norm = rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)
    left, order = np.ones(len(rows), bool), [0]
    left[0] = False
    while left.any():
        near = np.where(left, norm @ norm[order[-1]], -1.0)
        order.append(int(near.argmax()))
        left[order[-1]] = False
    return order


class Search:
    """The best k documents so far of every item, in one task."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        n = len(items.names)
        self.best: list[list[tuple]] = [[] for _ in range(n)]  # (-score, id is null, id), the best first
        self.kth = np.ones(n)  # a score has to reach this
        self.scored = self.passed = 0  # pairs of documents and items

    def add(self, ids: list, sizes: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> None:
        """A chunk of documents: ``terms`` and ``parts`` stand one after the other, ``sizes`` of each."""
        if not len(ids) or not self.items.names:
            return
        parts = parts.astype(self.items.weights.dtype)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        maxima = self.items.levels[-1][0]
        fit = np.zeros((len(ids), maxima.shape[1]))
        filled = np.flatnonzero(sizes)
        if len(filled):
            gains = maxima[terms] * parts[:, None]
            fit[filled] = np.add.reduceat(gains, starts[:-1][filled], axis=0)
        order = np.lexsort((-fit.max(axis=1), fit.argmax(axis=1)))  # by the item node that a document fits best
        leaves = [order[i:i + _LEAF] for i in range(0, len(order), _LEAF)]
        nodes = [_DocNode.leaf(rows, starts, terms, parts) for rows in leaves]
        while len(nodes) > 1:
            nodes = [_DocNode.over(nodes[i:i + _FAN]) for i in range(0, len(nodes), _FAN)]
        self._visit(nodes[0], 0, np.arange(1), ids)

    def _visit(self, doc: "_DocNode", level: int, alive: np.ndarray, ids: list) -> None:
        maxima, of_item, children = self.items.levels[level]
        bound = doc.parts @ maxima[np.ix_(doc.terms, alive)]
        weakest = np.minimum.reduceat(self.kth, np.unique(of_item, return_index=True)[1])[alive]
        keep = bound >= weakest
        if not keep.all():
            gone = np.isin(of_item, alive[~keep])
            self.passed += int(gone.sum()) * doc.size
        alive = alive[keep]
        if not len(alive):
            return
        last = level + 1 == len(self.items.levels)
        below = alive if last else np.concatenate([children[p] for p in alive])
        if doc.children:
            for child in sorted(doc.children, key=lambda d: -d.most):
                self._visit(child, level if last else level + 1, below, ids)
        elif last:
            self._score(doc, np.flatnonzero(np.isin(of_item, alive)), ids)
        else:
            self._visit(doc, level + 1, below, ids)

    def _score(self, doc: "_DocNode", items: np.ndarray, ids: list) -> None:
        self.scored += doc.size * len(items)
        scores = doc.matrix @ self.items.weights[np.ix_(doc.terms, items)]
        for col in np.flatnonzero((scores >= self.kth[items]).any(axis=0)):
            j = int(items[col])
            found = np.flatnonzero(scores[:, col] >= self.kth[j])
            rows = [(-int(scores[i, col]), ids[doc.rows[i]] is None, ids[doc.rows[i]]) for i in found]
            self.best[j] = sorted(self.best[j] + rows, key=lambda r: (r[:2], r[2] if not r[1] else 0))[:self.k]
            if len(self.best[j]) == self.k:
                self.kth[j] = max(1, -self.best[j][-1][0])


class _DocNode:
    """Coordinate maxima of the documents below."""

    def __init__(self, terms: np.ndarray, parts: np.ndarray, size: int, children: list["_DocNode"],
                 rows: np.ndarray | None = None, matrix: np.ndarray | None = None) -> None:
        self.terms, self.parts, self.size, self.children, self.rows, self.matrix = terms, parts, size, children, rows, matrix
        self.most = float(parts.sum())

    @staticmethod
    def leaf(rows: np.ndarray, starts: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> "_DocNode":
        spans = [slice(starts[i], starts[i + 1]) for i in rows]
        held = np.concatenate([terms[s] for s in spans])
        own, place = np.unique(held, return_inverse=True)
        matrix = np.zeros((len(rows), len(own)), parts.dtype)
        matrix[np.repeat(np.arange(len(rows)), [s.stop - s.start for s in spans]), place] = np.concatenate([parts[s] for s in spans])
        return _DocNode(own, matrix.max(axis=0), len(rows), [], rows, matrix)

    @staticmethod
    def over(children: list["_DocNode"]) -> "_DocNode":
        own, place = np.unique(np.concatenate([c.terms for c in children]), return_inverse=True)
        parts = np.zeros(len(own), children[0].parts.dtype)
        np.maximum.at(parts, place, np.concatenate([c.parts for c in children]))
        return _DocNode(own, parts, sum(c.size for c in children), children)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, term)`` once each, terms as UTF-8; rows of one id are one item, a null id is one too."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t"))
    return (rows.mapInArrow(split, f"item {kind}, terms array<binary>")
            .select("item", F.explode("terms").alias("term")).distinct())


def _vectors(docs: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of documents with a term; terms by number, only those of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            at, sizes, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    counts = Counter(words)
                    own = sorted((number[w], counts[w]) for w in counts.keys() & number.keys())
                    at.append(i)
                    sizes.append(len(words))
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _searched(vectors: DataFrame, items: Items, n_docs: int, total: int, k: int) -> DataFrame:
    """At most k rows per item and task: ``(item, doc_id, score)``, item by its place in ``items``."""
    shared = vectors.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, kind = Search(shared.value, k), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                ids, sizes = part.column("doc_id").to_pylist(), part.column("n").to_pylist()
                terms, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                held = np.array(part.column("terms").value_lengths().to_pylist(), np.int64)
                ends = np.cumsum(held)
                parts = [fractions(tfs[e - h:e], n, n_docs, total) for n, h, e in zip(sizes, held.tolist(), ends.tolist())]
                found.add(ids, held, terms, np.concatenate(parts) if parts else np.zeros(0, np.int64))
        if kind is not None:
            rows = [(j, r[2], -r[0]) for j, best in enumerate(found.best) for r in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(search, f"item int, doc_id {kind}, score long")


def _best(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id_col: str = "doc_id", item_id_col: str = "item_id",
           text_col: str = "text", max_cells: int = 4_000_000) -> DataFrame:
    """The k best documents of every item: ``item_id, rank, doc_id, score``, scores above 0.

    Null and empty texts have no term: such documents are in no result and in no
    count, such items have no rows.  Equal scores go by ascending id, nulls last;
    repeated documents rank one after the other.  Items go to the tasks as a table
    of terms by items of at most ``max_cells`` numbers (32 MB); more of them are dealt
    to groups, each of which reads the documents once more (an item alone
    above the bound is a group of its own).
    """
    spark = docs.sparkSession
    asked = materialise(item_terms(items, item_id_col, text_col), "ranked-items")
    result = None
    for group in _groups(asked, max_cells):
        found = _ranked_group(docs, group, k, doc_id_col, text_col)
        result = found if result is None else result.union(found)
    if result is None:
        kinds = items.schema[item_id_col].dataType.simpleString(), docs.schema[doc_id_col].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    kind = items.schema[item_id_col].dataType
    return result.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _groups(asked: DataFrame, max_cells: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their terms, in groups of at most ``max_cells`` terms by items."""
    group, terms = [], set()
    rows = asked.groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item")
    for r in rows.toLocalIterator():
        own = [bytes(t) for t in r.terms]
        if group and len(terms.union(own)) * (len(group) + 1) > max_cells:
            yield group
            group, terms = [], set()
        group.append((r.item, own))
        terms.update(own)
    if group:
        yield group


def _ranked_group(docs: DataFrame, group: list[tuple[object, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in group for t in terms}))}
    vectors = materialise(_vectors(docs, numbers, id_col, text_col), "ranked-vectors")
    size = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    n_docs, total = int(size.n), int(size.total or 0)
    dfs = {r.term: r.df for r in vectors.select(F.explode("terms").alias("term")).groupBy("term")
           .agg(F.count("*").alias("df")).toLocalIterator()}  # a row per term of the group at most
    weights = {t: weight(n_docs, dfs.get(i, 0)) for t, i in numbers.items()}
    made = Items.of([name for name, _ in group], [[(numbers[t], weights[t]) for t in terms] for _, terms in group], len(numbers))
    rows = _searched(vectors, made, n_docs, max(total, 1), k)
    rows = materialise(rows.withColumn("salt", F.spark_partition_id() % shuffle_partitions(spark)), "ranked-parts")
    best = _best(_best(rows, ["item", "salt"], k).drop("rank", "salt"), ["item"], k)
    named = spark.createDataFrame([(j, None if x is None else str(x)) for j, x in enumerate(made.names)], "item int, item_id string")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # a group's items
