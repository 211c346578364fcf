"""Best-fit packing of tokenized documents into fixed-length sequences.

A document's ids end with the separator id; only documents above the capacity
are cut, into capacity-long pieces and a rest.  Packing depends on piece lengths
alone, so it is solved on the histogram of lengths (at most ``capacity`` rows,
whatever the corpus): pieces above one third of the capacity fit at most twice
in a sequence and are matched greedily, the longest first with the longest
partner that fits; smaller pieces then go, the longest first, to the tightest
remaining gap.  The solution is a short list of rank ranges per length.  Pieces
get their rank among equals from per-partition counts, and a join with the list
gives each its sequence and offset: no task sees more than its own pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.llm.common import materialise, shuffle_partitions

_PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
_PLAN = "length long, first long, n long, per long, sequence long, offset long"
#: Byte-level vocabularies write a byte that is no printable Latin-1 character as the next free letter from U+0100.
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173))}
#: Words remembered per task before the memory is emptied.
_REMEMBERED = 600_000


def _latin(text: str) -> bool:
    """Only characters up to Latin Extended-A with one lower case each, all composed."""
    return text.isascii() or max(text) < "\u0180" and "\u0130" not in text


def _words(text: str) -> list[str]:
    """Words between white space; the four ASCII separators that Python alone takes for it are none here."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in re.split(r"[ \t\n\r]+", text) if w]
    return text.split()


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary file splits texts at white space before anything else, so a
    text's ids are its words' ids in order and rare work is shared: each distinct
    word is encoded once per task.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.encoder = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.merges = self.encoder.model

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        words = [_words(t.lower() if _latin(t) and "<|" not in t else t) for t in texts]
        whole = []
        for w in set().union(*words) - self.known.keys():
            letters = w if w.isalpha() else w.rstrip(punctuation)  # a token never spans letters and marks
            marks = w[len(letters):]
            if letters.isalpha() and _latin(letters):
                run = letters.lower()  # one run for the merges
                if not run.isascii():
                    run = run.encode().decode("latin-1").translate(_BYTE_LETTERS)
                self.known[w] = array("I", [t.id for t in self.merges.tokenize(run)]).tobytes() + self._marks(marks)
            else:
                whole.append(w)
        for w, e in zip(whole, self.encoder.encode_batch_fast(whole, add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()
        return [b"".join(map(self.known.__getitem__, p)) for p in words]

    def _marks(self, marks: str) -> bytes:
        if marks and marks not in self.known:
            self.known[marks] = array("I", self.encoder.encode(marks, add_special_tokens=False).ids).tobytes()
        return self.known[marks] if marks else b""


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def _batched(texts: pd.Series, chars: int = 1_000_000):
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(text: Column, path: str, capacity: int = 2048, separator: int = 0) -> Column:
    """Array of ``(piece, start, length, ids_crc32)`` for a text; null counts as empty (the separator alone)."""
    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        tokens, end, out = _tokens(path), np.array([separator], "<u4").tobytes(), []
        for batch in _batched(texts):
            for ids in tokens.of(batch):
                ids = memoryview(ids + end)
                out.append([(i // (4 * capacity), i // 4, min(4 * capacity, len(ids) - i) // 4,
                             zlib.crc32(ids[i:i + 4 * capacity])) for i in range(0, len(ids), 4 * capacity)])
        return pd.Series(out)
    return cut(text)


def solve(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Rank ranges ``(length, first, n, per, sequence, offset)`` that place all pieces.

    Ranks ``first`` to ``first + n`` of a length fill sequences from ``sequence``
    on, ``per`` in each, back to back from ``offset``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    open_bins: dict[int, list[list]] = {}  # gap -> [[number of bins, ((length, per), ...)]]
    gaps: list[int] = []

    def put(n: int, content: tuple) -> None:
        gap = capacity - sum(a * k for a, k in content)
        if n:
            if gap not in open_bins:
                open_bins[gap] = []
                insort(gaps, gap)
            open_bins[gap].append([n, content])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m + n <= capacity and left[m] > (m == n)), None)
            if partner is None:
                put(left[n], ((n, 1),))
                left[n] = 0
            elif partner == n:
                put(left[n] // 2, ((n, 2),))
                left[n] %= 2
            else:
                pairs = min(left[n], left[partner])
                put(pairs, ((n, 1), (partner, 1)))
                left[n] -= pairs
                left[partner] -= pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                put(left[n] // per, ((n, per),))
                if left[n] % per:
                    put(1, ((n, left[n] % per),))
                left[n] = 0
                continue
            gap = gaps[at]
            bins, content = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            per = gap // n
            full = min(bins, left[n] // per)
            left[n] -= full * per
            put(full, (*content, (n, per)))
            bins -= full
            if bins and left[n]:  # fewer are left than one more bin could take
                put(1, (*content, (n, left[n])))
                left[n] = 0
                bins -= 1
            put(bins, content)
    plan, rank, sequence = [], dict.fromkeys(left, 0), 0
    for gap in gaps:
        for bins, content in open_bins[gap]:
            offset = 0
            for n, per in content:
                plan.append((n, rank[n], bins * per, per, sequence, offset))
                rank[n] += bins * per
                offset += n * per
            sequence += bins
    return plan


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         separator: int = 0) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty; repeated rows and null ids are documents of their
    own; an empty table gives no rows.  Ties among pieces of one length go by
    document, piece and checksum.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_partitions(spark))).cast("int")
    table = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.explode(pieces(docs[text_col], path, capacity, separator)).alias("p"))
        .select("doc_id", "p.*").withColumn("salt", salt), "packing-pieces")
    per_salt = materialise(table.groupBy("length", "salt").count(), "packing-counts")
    counts = {r.length: r.n for r in per_salt.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.createDataFrame(solve(counts, capacity), _PLAN)
    before = per_salt.select("length", "salt", (F.sum("count").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    ranked = table.join(before, ["length", "salt"]).withColumn("rank", F.col("before") - 1 + F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    # the plan's size depends on the capacity alone
    placed = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (ranked["rank"] >= plan["first"])
                         & (ranked["rank"] < plan["first"] + plan["n"]))
    nth = ranked["rank"] - plan["first"]
    return placed.select("doc_id", "piece", "start", ranked.length, "ids_crc32",
                         (plan["sequence"] + F.floor(nth / plan["per"])).cast("long").alias("sequence_id"),
                         (plan["offset"] + nth % plan["per"] * ranked.length).cast("long").alias("offset"))
