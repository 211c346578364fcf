import hashlib

import numpy as np

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import fingerprints as P


def jaccard(a, b):
    a, b = P.weights(a), P.weights(b)
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_equal_samples_estimate_generalised_jaccard():
    off = []
    for s in range(60):
        a, b = words(200, s), words(200, s + 500)
        cut = s * 3
        x, y = " ".join(a), " ".join(a[:cut] + b[cut:])
        p, q = P.fingerprints([x, y])
        off.append(P.likeness(p, q) - jaccard(x, y))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08


def test_chunks_and_batches_change_nothing(monkeypatch):
    texts = [" ".join(words(300, s)) for s in range(6)] + ["", "!!", "x"]
    whole = P.fingerprints(texts)
    monkeypatch.setattr(P, "_CHUNK", 4)
    assert (P.fingerprints(texts) == whole).all()
    assert all((P.fingerprints([t])[0] == w).all() for t, w in zip(texts, whole))
    assert not whole[6].any() and not whole[7].any() and whole[8].all()


def test_rows_equal_direct_computation(spark):
    rows = [r for r in AWKWARD if r[0] != 4 and r[0] is not None] + [(None, "one null id")] + [(50 + i, " ".join(words(20 + i, i))) for i in range(40)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r.doc_id: r for r in P.document_fingerprints(clashing(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, f) in zip(order, order[1:] + order[:1]):
        t, f = t or "", f or ""
        e = P.edited(t, f)
        half = len(t) // 2
        assert e == t[:len(t) - half] + f[:half]
        a, b, c = P.fingerprints([t, e, f])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (P.as_text(a), P.as_text(b))
        assert (r.near_edited, r.near_next) == (P.likeness(a, b), P.likeness(a, c))


def test_ties_single_rows_and_no_rows(spark):
    assert P.document_fingerprints(docs(spark, AWKWARD)).count() == len(AWKWARD)
    one = P.document_fingerprints(docs(spark, [(1, "only one here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert P.document_fingerprints(docs(spark, AWKWARD).limit(0)).count() == 0
