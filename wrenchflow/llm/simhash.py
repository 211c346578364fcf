"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit b is one if more than half of the XXH64 values
(seed 42) of the text's word shingles have it.  Two documents link if their
fingerprints differ in at most ``radius`` bits.

Candidates come from structured bit masks.  Each of the 64 positions gets a
non-zero vector of F_2^(radius+1); mask v keeps the positions whose vector has
an odd product with v.  The vectors of any ``radius`` differing positions span
a proper subspace, so some non-zero v is orthogonal to all of them, and that
mask sees two equal keys: every pair within the radius collides in one of the
2^(radius+1) - 1 tables.  A bucket above ``split_above`` fingerprints is dealt
out again by the same masks over the positions its key left free, which is
exact for the same reason; each level halves the free positions.

Only distinct fingerprints are compared, and a bucket hands on a spanning
forest of its links, so copies and dense groups cost rows linear in their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchflow.llm.common import materialise
from wrenchflow.llm.components import components

_BITS = 64
_ALL = (1 << _BITS) - 1
#: Shingles summed at a time, so that a very long text needs bounded memory.
_CHUNK = 65536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; null or no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(stops)
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(line[a:b], 42) for a, b in
                      zip(starts[at:at + _CHUNK], stops[at:at + _CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series, shingle: pd.Series) -> pd.Series:
    out = np.array([fingerprint(t, int(k)) for t, k in zip(text, shingle)], dtype=np.uint64)
    return pd.Series(out.view(np.int64))


def masks(radius: int, free: int = _ALL) -> list[int]:
    """The covering masks over the positions in ``free`` as unsigned integers."""
    dim = radius + 1
    places = [b for b in range(_BITS) if free >> b & 1]
    vectors = {b: 1 + i % ((1 << dim) - 1) for i, b in enumerate(places)}
    return [sum(1 << b for b in places if (vectors[b] & v).bit_count() & 1) for v in range(1, 1 << dim)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(keys: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, one row against the rest at a time."""
    group, out = np.arange(len(keys)), []
    for i in range(len(keys) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(keys[i + 1:] ^ keys[i]) <= radius)
        others, first = np.unique(group[near], return_index=True)
        for g, k in zip(others.tolist(), first.tolist()):
            if g != group[i]:
                out.append((i, int(near[k])))
                group[group == g] = group[i]
    return out


def _bucket_links(radius: int):
    """For rows sorted by (path, key): the forest of each bucket; the last bucket of a batch waits for the next."""
    def solve(run: np.ndarray) -> pd.DataFrame:
        at = np.array(_forest(run.view(np.uint64), radius), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": run[at[:, 0]], "v": run[at[:, 1]]})

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = key = fp = np.empty(0, np.int64)
        for df in batches:
            path, key, fp = (np.concatenate((held, df[c].to_numpy(np.int64)))
                             for held, c in ((path, "path"), (key, "key"), (fp, "fp")))
            cut = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], cut)) if len(fp) else cut
            found = [solve(fp[bounds[k]:bounds[k + 1]]) for k in np.flatnonzero(np.diff(bounds) > 1).tolist()]
            if found:
                yield pd.concat(found, ignore_index=True)
            if len(bounds):
                path, key, fp = path[bounds[-1]:], key[bounds[-1]:], fp[bounds[-1]:]
        if len(fp) > 1:
            yield solve(fp)
    return links


def _dealt(rows: DataFrame, tables: list[tuple[int, int, int]]) -> DataFrame:
    """Each row of a path once per mask of that path: (path, key, fp)."""
    entry = F.array(*[F.struct(F.lit(p).alias("old"), F.lit(q).alias("path"), F.lit(_signed(m)).alias("mask"))
                      for p, q, m in tables])
    return (rows.withColumn("e", F.explode(entry)).where("e.old = path")
            .select(F.col("e.path").alias("path"), F.col("fp").bitwiseAND(F.col("e.mask")).alias("key"), "fp"))


def links(fps: DataFrame, radius: int = 3, split_above: int = 20000) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct ``fp`` within ``radius`` bits of each other.

    Every pair within the radius ends in one component of the links; of a dense
    bucket a spanning forest is given instead of all pairs.
    """
    def solved(rows: DataFrame) -> DataFrame:
        return (rows.repartition("path", "key").sortWithinPartitions("path", "key", "fp")
                .mapInPandas(_bucket_links(radius), "u long, v long"))

    level = [(0, i + 1, m) for i, m in enumerate(masks(radius))]
    rows = _dealt(fps.select(F.lit(0).alias("path"), "fp"), level)
    out = None
    while True:
        hot = materialise(rows.groupBy("path", "key").count().where(F.col("count") > split_above)
                          .select("path", "key"), "simhash-hot")
        paths = {r.path for r in hot.select("path").distinct().collect()}
        found = solved(rows.join(hot, ["path", "key"], "left_anti") if paths else rows)
        out = found if out is None else out.union(found)
        free = {q: _ALL & ~m for _, q, m in level if q in paths}
        level = [(q, q * 64 + i + 1, _ALL & ~f | m) for q, f in free.items() if f.bit_count() > 2 * radius + 2
                 for i, m in enumerate(masks(radius, f))]
        ended = [q for q, f in free.items() if f.bit_count() <= 2 * radius + 2]
        if ended:  # so few positions are free that a bucket's size is bounded
            out = out.union(solved(rows.where(F.col("path").isin(ended)).join(hot, ["path", "key"])))
        if not level:
            return out
        rows = _dealt(rows.join(hot, ["path", "key"]), level)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   radius: int = 3, split_above: int = 20000) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fp, root, component_id``.

    ``root`` names the component (its least fingerprint) and ``component_id`` is
    the least id among documents reachable over links of at most ``radius``
    differing bits, the document itself included.  Null texts count as empty and
    have fingerprint 0; null ids never serve as component id unless all ids of
    the component are null; repeated rows stay repeated; an empty table gives no
    rows.  ``text_hash`` tells apart rows of equal id.
    """
    keyed = materialise(docs.select(
        F.col(id_col).alias("doc_id"), _text_hash(F.col(text_col)).alias("text_hash"),
        _fingerprints(F.col(text_col), F.lit(shingle)).alias("fp")), "simhash-docs")
    least = keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    cc = materialise(components(links(least.select("fp"), radius, split_above), "simhash"), "simhash-cc")
    of_root = (cc.join(least, cc.node == least.fp).groupBy("root").agg(F.min("first_id").alias("component_id")))
    linked = cc.join(of_root, "root").select(F.col("node").alias("fp"), "root", "component_id")
    named = materialise(  # so that the join below is plain and a fingerprint of many copies is split
        least.join(linked, "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"),
                F.coalesce("component_id", "first_id").alias("component_id")), "simhash-named")
    return keyed.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     radius: int = 3) -> DataFrame:
    """``docs`` with one document of each SimHash group, in all its columns.

    The document of the least id stays (null ids come last, ties go to the least
    text hash); of repeated rows of that id and text one stays.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, radius)
    kept = materialise(
        groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("w"))
        .select(F.col("w.doc_id").alias("__kept_id"), F.col("w.text_hash").alias("__kept_hash")), "simhash-kept")
    rows = docs.withColumn("__text_hash", _text_hash(F.col(text_col)))
    rows = rows.join(kept, rows[id_col].eqNullSafe(kept["__kept_id"]) & (rows["__text_hash"] == kept["__kept_hash"]),
                     "left_semi")
    return rows.dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")
