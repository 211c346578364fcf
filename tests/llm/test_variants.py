import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import variants as V
from wrenchflow.llm.queries import QUERIES


def one_edit(x, y):
    if len(x) < len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1:] == y for i in range(len(x)))


def brute(rows, least_count=5, factor=5):
    """Straight from the contract: every run, every pair of words."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_count}
    near, form = {}, {}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def result(df, **how):
    got = V.spelling_variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in got)


def family_rows():
    """Texts with families of words an edit apart, in chains of falling frequency."""
    rng = np.random.default_rng(5)
    stems = [w for w in words(400, 9) if 5 <= len(w) <= 9][:40]
    rows = []
    for d in range(120):
        text = []
        for s in stems:
            w = s + "er"
            text += [w] * int(rng.integers(1, 5))
            if rng.random() < 0.5:
                at = int(rng.integers(0, len(w)))
                edit = "xyzé"[int(rng.integers(0, 4))]
                text.append([w[:at] + w[at + 1:], w[:at] + edit + w[at:], w[:at] + edit + w[at + 1:]][int(rng.integers(0, 3))])
        rows.append((d, " ".join(text).title() if d % 3 else " ".join(text)))
    chain = ["bramble"] * 900 + ["bramblex"] * 150 + ["bramblexy"] * 25 + ["bramlexy"] * 5
    return [*rows, (7000, " ".join(chain))]


@pytest.mark.parametrize("split_above", [1, 4, 384])
def test_equals_brute_force_at_any_group_size(spark, split_above):
    rows = family_rows() + AWKWARD
    want = brute(rows)
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    assert result(docs(spark, rows), split_above=split_above) == want


def test_dense_family_splits_to_single_positions(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    family = [f"common{a}{b}" for a in letters for b in letters] + ["commona", "commonabÿ"]
    counts = spark.createDataFrame([(w, 5 + i % 7) for i, w in enumerate(family)], "word string, n long")
    largest = max(r["count"] for r in V.groups(counts, 16).groupBy("c", "a", "b", "shared").count().collect())
    assert largest <= 100
    got = {r.word: r for r in V.neighbours(counts, 16).collect()}
    n = dict(zip(family, [5 + i % 7 for i in range(len(family))]))
    for w in family:
        near = [v for v in family if one_edit(w, v)]
        assert got[w].n_near == len(near) and got[w].form == min(near, key=lambda v: (-n[v], v)) and got[w].form_n == n[got[w].form]


def test_tile_rule_equals_edit_check():
    rng = np.random.default_rng(0)
    some = sorted({"".join("abą"[i] for i in rng.integers(0, 3, int(rng.integers(5, 8)))) for _ in range(250)})
    near, prefix = V.near_pairs(some)
    for i, x in enumerate(some):
        for j, y in enumerate(some):
            assert near[i, j] == one_edit(x, y)


def test_runs_and_checksum():
    assert V.runs_of("AbÉ×ÿ1 Āx_Y’z") == ["abÉ×ÿ".encode("latin-1"), b"x", b"y", b"z"]
    assert V.runs_of(None) == []
    run = "étionables"
    hits = [i for i in range(3000) if zlib.crc32(f"{i}:{run}".encode()) % 199 == 0]
    for i in range(3000):
        got = V.words_of(str(i), run.upper().replace("É", "é"), 6, 199)
        assert (got == Counter({run.encode("latin-1"): 1})) == (i not in hits)
    assert hits


def test_awkward_and_empty_tables(spark):
    rows = [(i, "seventeen seventeem") for i in [1, 1, 2, 3, None, None]] + AWKWARD
    df = clashing(spark, rows)
    assert result(df, least_count=2) == brute(rows, 2)
    assert result(df.limit(0)) == []
    assert V.spelling_variants(df.limit(0)).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_query_equals_brute_force_on_all_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_spelling_variants"](spark, d).collect())
    assert got == brute(rows) and len(got) > 100
