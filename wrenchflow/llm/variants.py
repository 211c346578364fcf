"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes them
equal: exactly then the lengths of their common prefix and common suffix add up
to the longer length minus one or more.  Tiles of words stand as padded
code-point matrices, once aligned at the start and once at the end; a tile
compares all its rows with each other, position by position.

Which words share a tile follows from the same rule.  With ``c`` the longer
length, the edit stands at one of ``c`` positions; words whose edit lies in
``[a, b)`` share their first ``a`` and their last ``c - b`` code points.  Each word
is dealt to the halves of the positions, for pairs in which it is the longer word
and for pairs in which it is the shorter one.  A group above ``split_above`` words
is dealt again by the halves of its interval, down to one position, where a group
holds no more words than the alphabet has letters (and one shorter word).  A pair
is counted where its common prefix lies in the group's interval: once.

Tiles hand on a count and the best neighbour per word, no pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.llm.common import materialise, shuffle_partitions

#: Bytes of Latin-1: A-Z to a-z, letters (as the contract's class takes them) stay, the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Words counted in a task before the counts are handed on; rows of a tile, unless one group has more.
_HELD, _TILE = 200_000, 128
_GROUP = ["c", "a", "b", "shared"]


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, as Latin-1; code points above U+00FF separate."""
    return (text or "").encode("latin-1", "replace").translate(_FOLD).split()


def misspelled(run: bytes, prefix: int, every: int) -> bytes:
    """The run, without one code point if ``every`` divides the checksum that goes on from ``prefix``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1:]


def words_of(doc_id: str | None, text: str | None, least: int, every: int) -> Counter:
    """Words of at least ``least`` code points with their number in one text."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words: Counter = Counter()
    for run, n in Counter(r for r in runs_of(text) if len(r) >= least).items():
        word = misspelled(run, prefix, every)
        if len(word) >= least:
            words[word] += n
    return words


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
                least_count: int = 5, every: int = 199) -> DataFrame:
    """``(word, n)`` of all texts, for words of enough code points and occurrences.

    Null and empty texts have none; a null id stands in the checksum as no text;
    repeated rows count as often as they stand.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                               pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(words_of(i, text.as_py(), least_length, every))
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    texts = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return (texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def _shared(word: Column, c: Column, a: Column, b: Column) -> Column:
    """The first ``a`` and the last ``c - b`` code points."""
    return F.concat(F.substring(word, F.lit(1), a), F.lit("\n"), F.substring(word, F.length(word) - (c - b) + 1, c - b))


def _dealt(words: DataFrame, halves: Column) -> DataFrame:
    """A row per word and interval; ``halves`` is an array of (c, a, b)."""
    rows = words.select("word", "n", F.explode(halves).alias("h")).select("word", "n", "h.c", "h.a", "h.b").where("a < b")
    return rows.withColumn("shared", _shared(F.col("word"), F.col("c"), F.col("a"), F.col("b")))


def _halves(c: Column, a: Column, b: Column) -> list[Column]:
    mid = F.floor((a + b + 1) / 2).cast("int")
    return [F.struct(c.alias("c"), a.alias("a"), mid.alias("b")), F.struct(c.alias("c"), mid.alias("a"), b.alias("b"))]


def groups(words: DataFrame, split_above: int) -> DataFrame:
    """``(word, n, c, a, b, shared)``: every word in all its groups, none above ``split_above`` that can be split."""
    length, zero = F.length("word"), F.lit(0)
    rows = _dealt(words, F.array(*_halves(length, zero, length), *_halves(length + 1, zero, length + 1)))
    parts = []
    while True:
        large = materialise(rows.groupBy(*_GROUP).count().where((F.col("count") > split_above) & (F.col("b") - F.col("a") > 1))
                            .drop("count"), "variant-large")
        if large.isEmpty():
            return reduce(DataFrame.union, [*parts, rows])
        parts.append(rows.join(large, _GROUP, "left_anti").select(*rows.columns))
        rows = materialise(_dealt(rows.join(large, _GROUP, "left_semi"),
                                  F.array(*_halves(F.col("c"), F.col("a"), F.col("b")))), "variant-halves")


def _matrix(words: list[str]) -> np.ndarray:
    """Code points, a row per word, padded with zeros."""
    width = max(map(len, words))
    codes = np.array(words, f"<U{width}").view("<u4").reshape(len(words), width)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


def _common(codes: np.ndarray) -> np.ndarray:
    """For every pair of rows the length of the common start."""
    n = len(codes)
    same, total = np.ones((n, n), bool), np.zeros((n, n), np.int16)
    for column in codes.T:
        same &= column[:, None] == column[None, :]
        total += same
    return total


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of (distinct) words whether they are near, and the length of their common prefix."""
    prefix, suffix = _common(_matrix(words)), _common(_matrix([w[::-1] for w in words]))
    size = np.array([len(w) for w in words], np.int16)
    longer = np.maximum(size[:, None], size[None, :])
    near = (prefix + suffix >= longer - 1) & (np.abs(size[:, None] - size[None, :]) <= 1)
    np.fill_diagonal(near, False)
    return near, prefix


def _judged(words: list[str], n: np.ndarray, group: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    """Per word of a tile that has a near word in its group: their number, and the best of them."""
    near, prefix = near_pairs(words)
    size = np.array([len(w) for w in words])
    near &= group[:, None] == group[None, :]
    near &= np.maximum(size[:, None], size[None, :]) == c[:, None]
    near &= (prefix >= a[:, None]) & (prefix < b[:, None])
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    found = np.flatnonzero(near.any(axis=1))
    best = [order[r] for r in np.where(near[found], rank[None, :], len(words)).min(axis=1)] if len(found) else []
    return {"word": [words[i] for i in found], "n_near": near[found].sum(axis=1).tolist(),
            "form": [words[i] for i in best], "form_n": [int(n[i]) for i in best]}


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; a tile ends with a group."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        yield from _compared(held, done := _cut(held))
        held = held.slice(done)
    if held is not None and held.num_rows:
        yield from _compared(held, held.num_rows)


def _edges(rows: pa.Table) -> np.ndarray:
    """Where groups start; the last of them may not be whole yet."""
    parts = [rows[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in _GROUP]
    change = np.zeros(max(rows.num_rows - 1, 0), bool)
    for p in parts:
        change |= p[1:] != p[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def _cut(rows: pa.Table) -> int:
    return int(_edges(rows)[-1]) if rows.num_rows else 0


def _compared(rows: pa.Table, stop: int) -> Iterator[pa.RecordBatch]:
    if not stop:
        return
    rows = rows.slice(0, stop)
    starts = _edges(rows)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, stop)))
    words = rows["word"].to_pylist()
    n, c, a, b = (rows[k].to_numpy() for k in ("n", "c", "a", "b"))
    ends, at = np.append(starts[1:], stop).tolist(), 0
    for k, end in enumerate(ends):
        if end - at >= _TILE or k + 1 == len(ends):
            made = _judged(words[at:end], n[at:end], group[at:end], c[at:end], a[at:end], b[at:end])
            if made["word"]:
                yield pa.RecordBatch.from_pydict(made, _NEAR)
            at = end


def neighbours(words: DataFrame, split_above: int = 384) -> DataFrame:
    """``(word, n_near, form, form_n)`` for words with a near word; the form is the near word of largest n.

    ``words`` has distinct words without null and their n; equal n go to the word
    earlier in code-point order.
    """
    spark = words.sparkSession
    dealt = groups(words.select("word", "n"), split_above)
    dealt = (dealt.repartition(shuffle_partitions(spark), *_GROUP).sortWithinPartitions(*_GROUP)
             .select("word", "n", *_GROUP))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return (dealt.mapInArrow(_tiles, "word string, n_near long, form string, form_n long")
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", "b.form", (-F.col("b.m")).alias("form_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every row of ``forms(word, form)``: where the chain of forms ends.

    Each round joins the table with itself and doubles the steps; a chain can't
    close, since a form has a larger n than its word.
    """
    steps = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(steps.join(onward, "root", "left")
                            .select("word", F.coalesce("further", "root").alias("root"),
                                    F.col("further").isNotNull().alias("moved")), "variant-roots")
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
                      least_count: int = 5, every: int = 199, factor: int = 5, split_above: int = 384) -> DataFrame:
    """Per word of all texts: ``word, n, n_near, form, form_n, root``.

    ``form`` is the near word of largest n (ties: first in code-point order) if its n
    is at least ``factor`` times the word's, else null; ``root`` is where following
    forms ends, the word itself without one.  No rows for an empty table.
    """
    words = materialise(word_counts(docs, id_col, text_col, least_length, least_count, every), "variant-words")
    near = neighbours(words, split_above)
    kept = F.col("form_n") >= factor * F.col("n")
    judged = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("form")).alias("form"),
        F.when(kept, F.col("form_n")).alias("form_n")), "variant-forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
