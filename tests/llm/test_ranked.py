import math
import re
from collections import Counter

import numpy as np

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import ranked as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items, k):
    held = [(i, terms(t)) for i, t in rows]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, w, c in held:
            m = 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda r: (r[:2], r[2] or 0))
        out += [(item, p + 1, i, -s) for p, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def result(df, items, k, **how):
    return sorted((tuple(r) for r in R.ranked(df, items, k, **how).collect()), key=str)


def rows_and_items():
    rows = [(i, " ".join(words(20 + i * 7 % 300, i % 90))) for i in range(400)] + AWKWARD
    items = [(100 + j, " ".join(words(300, j)[5:40])) for j in range(0, 60, 2)] + [(100, "bo bo ba"), (7, None), (8, "..."), (None, "same words")]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = rows_and_items()
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, 9)
    assert result(docs(spark, rows), asked, 9) == want
    assert result(docs(spark, rows), asked, 9, max_cells=300) == want  # many groups of items


def test_ties_repeated_rows_and_clashing_names(spark):
    rows = [(i % 7, "alpha beta") for i in range(40)] + [(None, "alpha beta"), (50, "gamma")] + AWKWARD
    items = [(1, "beta ALPHA beta"), (1, "delta"), (2, "é\U0001F600 x")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert result(clashing(spark, rows), asked, 5) == brute(rows, items, 5)


def test_empty_tables(spark):
    rows, items = rows_and_items()
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert result(docs(spark, rows).limit(0), asked, 3) == []
    none = R.ranked(docs(spark, rows), asked.limit(0), 3)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.collect() == []


def clustered(n_docs, seed=1):
    """Documents of twelve topics with terms of their own, a few of each item's words in some."""
    rng = np.random.default_rng(seed)
    per = 40
    items = [[(int(t) + per * (j % 12), int(rng.integers(2000, 9000))) for t in rng.choice(per, 12, replace=False)] for j in range(48)]
    chunk = []
    for d in range(n_docs):
        own = np.sort(rng.choice(per, int(rng.integers(1, 25)), replace=False)) + per * int(rng.integers(0, 12))
        chunk.append((own, rng.integers(10**4, 9 * 10**5, len(own))))
    return items, chunk, 12 * per


def test_search_is_exact_and_passes_batches_over():
    items, chunk, n_terms = clustered(3000)
    found = R.Search(R.Items.of(list(range(len(items))), items, n_terms), 6)
    for at in range(0, len(chunk), 1000):
        part = chunk[at:at + 1000]
        found.add(list(range(at, at + len(part))), np.array([len(t) for t, _ in part]),
                  np.concatenate([t for t, _ in part]), np.concatenate([p for _, p in part]))
    for j, item in enumerate(found.items.names):
        scores = [(-sum(w * dict(zip(t.tolist(), p.tolist())).get(u, 0) for u, w in items[item]), i) for i, (t, p) in enumerate(chunk)]
        assert [(s, i) for s, _, i in found.best[j]] == sorted(scores)[:6]
    assert found.scored + found.passed == 3000 * len(items)
    assert found.passed > 0.5 * found.scored


def test_node_maxima_bound_their_children():
    items, _, n_terms = clustered(1)
    made = R.Items.of(list(range(len(items))), items, n_terms)
    assert len(made.levels) > 2
    for maxima, node, _ in made.levels:
        for j in range(len(items)):
            assert (maxima[:, node[j]] >= made.weights[:, j]).all()


def test_long_items_are_added_up_in_whole_numbers():
    made = R.Items.of([1], [[(t, 42_000) for t in range(R._EXACT_TERMS + 1)]], R._EXACT_TERMS + 1)
    assert made.weights.dtype == np.int64
