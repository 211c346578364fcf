"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

Items (test questions with their answers) and documents are normalised alike:
A-Z lower-cased, words only.  A window is ``window`` consecutive item words; an item
of fewer words, but not none, is one window.  A document's words inside any
occurrence of a window are hit, and offsets lead back to the original text.

The automaton reads word numbers, three symbols a word.  Its patterns are the blocks of half a
window's words (rounded up) that stand at multiples of their size in an item: every
window holds one of them whole, and each item word stands in one pattern, not in
``window`` of them.  A document is scanned once; a block found is extended to both
sides as far as document and item agree, and such a run is hit if it has room
for a window.  Items shorter than a window are patterns as they are.

The automaton is built once per Python worker and scan.  A benchmark of more than
``max_chars`` characters is cut by item into groups below that bound; each group
scans the written table in a pass of its own, so one group at a time is in memory,
on the driver and in a worker (measured: 16 million characters, 2.6 million words,
take the worker about 0.5 GB).  Hits are united per document after the last pass.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.llm.common import ASCII_LOWER, WORD_PATTERN, materialise

_WORD = re.compile(WORD_PATTERN)

#: Half-open spans of characters of the original text, the longest runs of hit words.
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", _SPANS)])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(ASCII_LOWER))


def _symbols(n: int) -> str:
    """A word's number as three characters of ranges of their own: no node has more than 256 branches."""
    return chr(1 + (n >> 16)) + chr(257 + (n >> 8 & 255)) + chr(513 + (n & 255))


_UNKNOWN = _symbols(0)
_W = len(_UNKNOWN)


class Patterns:
    """The automaton of a group of items, with the items' word numbers to extend a block found."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.size, self.number, self.items, places = size, {}, [], {}
        block = (size + 1) // 2
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            for w in words:
                if w not in self.number:
                    self.number[w] = _symbols(len(self.number) + 1)
            item = "".join([self.number[w] for w in words])
            self.items.append(item)
            if len(words) >= size:
                for at in range(0, len(words) - block + 1, block):
                    places.setdefault(item[_W * at:_W * (at + block)], []).append((k, at))
            elif words:
                places.setdefault(item, []).append((k, 0))
        self.found = ahocorasick.Automaton()
        for pattern, of in places.items():
            self.found.add_word(pattern, (len(pattern) // _W, of))
        self.any = bool(places)
        if self.any:
            self.found.make_automaton()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of hit words, and the items whose windows occur."""
        ranges, items, seen = [], set(), {}
        if not (self.any and words):
            return ranges, items
        text = "".join(map(self.number.get, words, repeat(_UNKNOWN)))
        for last, (n, of) in self.found.iter(text):
            end = last // _W
            start = end - n + 1
            for k, at in of:
                if seen.get((k, start - at), -1) >= end:  # inside a run that this pair of places has shown before
                    continue
                item, a, b, shift = self.items[k], _W * start, _W * (end + 1), _W * (at - start)
                while a > 0 and a + shift > 0 and text[a - _W:a] == item[a + shift - _W:a + shift]:
                    a -= _W
                while b < len(text) and b + shift < len(item) and text[b:b + _W] == item[b + shift:b + shift + _W]:
                    b += _W
                seen[k, start - at] = b // _W - 1
                if b - a >= min(_W * self.size, len(item)):
                    ranges.append((a // _W, b // _W))
                    items.add(k)
        return ranges, items


def _digest(text: str | None, n_words: int, ranges: list[tuple[int, int]], items: set[str]) -> dict:
    hit = np.zeros(n_words + 1, np.int64)
    for a, b in ranges:
        hit[a] += 1
        hit[b] -= 1
    flags = np.cumsum(hit[:n_words]) > 0
    n_hit, ids, spans = int(flags.sum()), sorted(items), []
    if n_hit:
        places = [m.span() for m in _WORD.finditer(text.translate(ASCII_LOWER))]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edge[::2], edge[1::2])]
    return {"n_words": n_words, "n_hit": n_hit, "n_items": len(ids),
            "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(),
            "contaminated": n_hit > 0 and 20 * n_hit >= n_words, "items": ids, "spans": spans}


def _groups(benchmark: DataFrame, id_col: str, text_col: str, max_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in groups of at most ``max_chars`` characters (a longer item alone), one at a time."""
    rows = (benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
            .where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator())
    group, used = [], 0
    for r in rows:
        if group and used + len(r.t) > max_chars:
            yield group
            group, used = [], 0
        group.append((r.i, r.t))
        used += len(r.t)
    yield group


_HELD: dict[int, Patterns] = {}


def _patterns(shared, size: int) -> Patterns:
    """The worker's patterns of this broadcast group; those of an earlier group go."""
    if shared.value[0] not in _HELD:
        _HELD.clear()
        _HELD[shared.value[0]] = Patterns(shared.value[1], size)
    return _HELD[shared.value[0]]


_PART = T.StructType([T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "contamination",
                  id_col: str = "item_id", item_col: str = "text", window: int = 13, max_chars: int = 16_000_000) -> DataFrame:
    """``docs`` with a struct column ``out`` (``_RESULT``) that judges the text against all benchmark items.

    Null and empty texts have no words and no hits; items that are null or have no
    word match nothing; equal items under several ids all count; an empty
    benchmark contaminates nothing.
    """
    groups = _groups(benchmark, id_col, item_col, max_chars)
    first, second = next(groups), next(groups, None)
    share = docs.sparkSession.sparkContext.broadcast
    if second is None:
        return docs.withColumn(out, _judge(share((uuid.uuid4().int, first)), window)(F.col(text_col)))
    names, rows = [], docs
    for n, group in enumerate(chain((first, second), groups)):
        shared = share((uuid.uuid4().int, group))
        names.append(f"__scan{n}")
        rows = materialise(rows.withColumn(names[-1], _scanner(shared, window)(F.col(text_col))), "benchmark-scan")
        shared.unpersist()

    @F.pandas_udf(_RESULT)
    def united(texts: pd.Series, ranges: pd.Series, items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(t, len(words_of(t)), [tuple(x) for x in r], set(i)) for t, r, i in zip(texts, ranges, items)],
                            columns=_RESULT.names)

    ranges = F.concat(*[F.col(f"{c}.ranges") for c in names])
    items = F.concat(*[F.col(f"{c}.items") for c in names])
    return rows.withColumn(out, united(F.col(text_col), ranges, items)).drop(*names)


def _judge(shared, size: int):
    @F.pandas_udf(_RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        found, rows = _patterns(shared, size), []
        for text in texts:
            words = words_of(text)
            ranges, items = found.scan(words)
            rows.append(_digest(text, len(words), ranges, {shared.value[1][k][0] for k in items}))
        return pd.DataFrame(rows, columns=_RESULT.names)
    return judged


def _scanner(shared, size: int):
    @F.pandas_udf(_PART)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        found, parts = _patterns(shared, size), []
        for text in texts:
            ranges, items = found.scan(words_of(text))
            parts.append(([list(r) for r in ranges], sorted({shared.value[1][k][0] for k in items})))
        return pd.DataFrame(parts, columns=_PART.names)
    return scanned


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13,
                   max_chars: int = 16_000_000) -> DataFrame:
    """``docs`` without those that the benchmark contaminates; all columns are kept."""
    judged = contamination(docs, benchmark, text_col, "__contamination", window=window, max_chars=max_chars)
    return judged.where(~F.col("__contamination.contaminated")).drop("__contamination")
