"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (A-Z lower-cased), each weighted by the characters it
covers: count times length.  For every term and sample, hashed gamma variables
r, c ~ Gamma(2, 1) and a uniform b give t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r; the term of the least a, with its t, is the sample.
Two texts have equal samples with a probability that equals the generalised
Jaccard similarity of their weights, so the share of equal samples estimates it.
A sample is kept as 16 bits (never 0); a text without terms has all zeros.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchflow.llm.common import ASCII_LOWER, WORD_PATTERN, materialise, shuffle_partitions

_WORD = re.compile(WORD_PATTERN)
SAMPLES = 64
#: (term, weight) pairs worked on at a time.
_CHUNK = 8192
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, part int, edge string, text string")


def weights(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in _WORD.findall(text.translate(ASCII_LOWER)):
        out[w] = out.get(w, 0) + len(w)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def samples(term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a (float32) and 16-bit codes, a row per (term hash, weight) and a column per sample."""
    lna = np.empty((len(term), SAMPLES), np.float32)
    code = np.empty((len(term), SAMPLES), np.uint16)
    turn = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for a in range(0, len(term), _CHUNK):
            h = _mix(term[a:a + _CHUNK, None] + turn)
            g = _mix(h + np.uint64(0xD1B54A32D192ED03))

            def uniform(x: np.ndarray, shift: int, bits: int) -> np.ndarray:
                part = (x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                return (part.astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -bits)

            r = -np.log(uniform(h, 0, 24) * uniform(h, 24, 24))
            c = -np.log(uniform(g, 0, 24) * uniform(g, 24, 24))
            b = uniform(h, 48, 16)
            t = np.floor(np.log(weight[a:a + _CHUNK, None].astype(np.float32)) / r + b)
            lna[a:a + _CHUNK] = np.log(c) - r * (t - b) - r
            mark = _mix(g ^ (t.astype(np.int64).view(np.uint64) + np.uint64(1))) >> np.uint64(48)
            code[a:a + _CHUNK] = np.maximum(mark, np.uint64(1))
    return lna, code


def fingerprints(texts: list[str]) -> np.ndarray:
    """16-bit samples, a row per text; pairs of term and weight that texts share are drawn once."""
    known: dict[tuple[str, int], int] = {}
    rows, out = [], np.zeros((len(texts), SAMPLES), np.uint16)
    for text in texts:
        rows.append(np.array([known.setdefault(x, len(known)) for x in weights(text).items()], np.int64))
    if not known:
        return out
    seeds: dict[str, int] = {}
    term = np.array([seeds.get(w) or seeds.setdefault(w, xxhash.xxh64_intdigest(w)) for w, _ in known], np.uint64)
    weight = np.array([n for _, n in known], np.float64)
    best = np.full((len(texts), SAMPLES), np.inf, np.float32)
    column = np.arange(SAMPLES)
    for a in range(0, len(term), 16 * _CHUNK):  # bounds memory for a text of very many terms
        lna, code = samples(term[a:a + 16 * _CHUNK], weight[a:a + 16 * _CHUNK])
        for i, at in enumerate(rows):
            if a or len(term) > 16 * _CHUNK:
                at = at[(at >= a) & (at < a + 16 * _CHUNK)] - a
            if len(at):
                own = lna[at]
                least = own.argmin(axis=0)
                value = own[least, column]
                better = value < best[i]
                best[i][better] = value[better]
                out[i][better] = code[at[least], column][better]
    return out


def as_text(sample: np.ndarray) -> str:
    return sample.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: estimates the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the text's code points gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _record(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _rows(ids: list, texts: list[str], first: np.ndarray | None = None) -> tuple[pa.RecordBatch, np.ndarray]:
    """Finished rows of all documents but the last, which only follows, and its samples.

    ``first`` holds the first document's samples if they are known.  Texts and
    edited texts share most pairs of term and weight and so are drawn together.
    """
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    known = 0 if first is None else 1
    both = fingerprints(texts[known:] + changed)
    prints, theirs = both[:len(texts) - known], both[len(texts) - known:]
    if known:
        prints = np.concatenate((first[None], prints))
    return _record(
        doc_id=ids[:-1], n_chars=[len(t) for t in texts[:-1]],
        edited_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        fingerprint=[as_text(p) for p in prints[:-1]], edited_fingerprint=[as_text(p) for p in theirs],
        near_edited=[likeness(a, b) for a, b in zip(prints, theirs)],
        near_next=[likeness(a, b) for a, b in zip(prints, prints[1:])]), prints[-1]


def _batched(batches: Iterator[pa.RecordBatch], chars: int = 500_000) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(i)
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows of one sorted partition, and its first and last document."""
    part, held_ids, held_texts, held = TaskContext.get().partitionId(), [], [], None
    for ids, texts in _batched(batches):
        if not held_ids:
            yield _record(doc_id=ids[:1], text=texts[:1], part=[part], edge=["first"])
        ids, texts = held_ids + ids, held_texts + texts
        if len(ids) > 1:
            record, held = _rows(ids, texts, held)
            yield record
        held_ids, held_texts = ids[-1:], texts[-1:]
    if held_ids:
        yield _record(doc_id=held_ids, text=held_texts, part=[part], edge=["last"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows of documents whose next one lies in another partition."""
    for batch in batches:
        for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            yield _rows([i, None], [a, b])[0]


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, its edited text's, and their and the next document's likeness.

    Documents follow each other by descending id (nulls last, then by text); after
    the last comes the first, so a single document follows itself.  Null texts
    count as empty; an empty table gives no rows.  Only the first and last
    documents of partitions are met again to close the seams.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    done = materialise(rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
                       .mapInArrow(_along, _OUT), "fingerprints")
    first = done.where("edge = 'first'").select("part", F.col("text").alias("following"))
    # one row per partition that has documents
    number = Window.orderBy("part")
    parts = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(number), F.first("part").over(number)))
    last = done.where("edge = 'last'").select("part", "doc_id", "text").join(parts, "part")
    seams = last.join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    return done.where("edge is null").union(seams.mapInArrow(_across, _OUT)).drop("part", "edge", "text")
