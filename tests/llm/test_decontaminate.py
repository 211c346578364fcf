import hashlib
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import decontaminate as D


def brute(text, items, size=13):
    w, hit, ids = D.words_of(text), set(), set()
    for i, t in items:
        v = D.words_of(t)
        k = min(size, len(v))
        for a in range(len(v) - k + 1 if v else 0):
            for b in range(len(w) - k + 1):
                if w[b:b + k] == v[a:a + k]:
                    hit |= set(range(b, b + k))
                    ids.add(str(i))
    s = ",".join(sorted(ids))
    return len(w), len(hit), len(ids), hashlib.sha256(s.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, " ".join(words(30, 1))), (2, "Short, item!"), (10, " ".join(words(30, 1)[5:25])), (3, None), (4, "..."),
         (5, " ".join(["ab"] * 20))]


def rows():
    w, long = words(30, 1), words(400, 9)
    return AWKWARD + [
        (20, " ".join(w)), (21, ", ".join(x.upper() for x in w[3:20])), (22, " ".join(w[:12])),
        (23, " ".join(long[:200] + w[4:18] + long[200:])), (24, "a short ITEM. short-item"), (25, "ab " * 15),
        (26, "xab " + "ab " * 13), (27, " ".join(long + w + long + w[2:16]))]


@pytest.mark.parametrize("max_chars", [16_000_000, 60])
def test_judgement_equals_brute_force(spark, max_chars):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs(spark, rows())
    assert len(list(D._groups(bench, "item_id", "text", 60))) == 4
    got = D.contamination(df, bench, out="c", max_chars=max_chars).select("doc_id", "text", "c").collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.c.n_words, r.c.n_hit, r.c.n_items, r.c.items_sha256, r.c.contaminated) == brute(r.text, ITEMS), r.doc_id
        for s in r.c.spans:  # offsets lead to the original text
            assert D.words_of(r.text[s.start:s.end])
        assert sum(len(D.words_of(r.text[s.start:s.end])) for s in r.c.spans) == r.c.n_hit


def test_scan_equals_brute_force_on_few_words():
    """Random texts of few words: runs that overlap, repeat and cross blocks, for windows of several sizes."""
    rng = random.Random(1)
    for size in (1, 2, 3, 4, 7):
        for _ in range(60):
            some = lambda n: " ".join(rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randint(0, n)))
            items = [(str(i), some(14)) for i in range(4)]
            text = some(40)
            ranges, found = D.Patterns(items, size).scan(D.words_of(text))
            hit = {w for a, b in ranges for w in range(a, b)}
            n, n_hit, n_items, digest, _ = brute(text, items, size)
            ids = sorted(items[k][0] for k in found)
            assert (len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) == (n_hit, n_items, digest)


def test_a_worker_holds_one_group_and_builds_it_once(monkeypatch):
    built = []
    monkeypatch.setattr(D, "Patterns", lambda items, size: built.append(items) or object())
    shared = [SimpleNamespace(value=(n, [(str(n), "text")])) for n in range(4)]
    for s in shared:
        assert D._patterns(s, 13) is D._patterns(s, 13) and len(D._HELD) == 1
    assert len(built) == 4
    D._HELD.clear()


def test_nodes_stay_with_the_words():
    """At most one node of the automaton an item word's symbol, whatever the window."""
    text = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))
    assert D.Patterns([("1", text)], 13).found.get_stats()["nodes_count"] <= 3 * 20_000 + 1


def test_filter_keeps_columns_and_clean_rows(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = clashing(spark, rows())
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns
    want = sorted((str(i) for i, t in rows() if not brute(t, ITEMS)[-1]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_empty_benchmark_and_empty_table(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminated(docs(spark, rows()), none).count() == len(rows())
    assert D.decontaminated(docs(spark, rows()).limit(0), none).count() == 0
    assert docs(spark, rows()).limit(0).select(F.col("doc_id")).count() == 0
