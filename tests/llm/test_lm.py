import math
import re
import string
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import lm


def by_hand(rows):
    def cut(t):
        return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [lm.END]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    c = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (held(i), len(w := cut(t)), sum(c[x] > 0 for x in w), n,
                     sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows}


def test_counts_and_base_equal_plain_python(spark, monkeypatch):
    rows = [(i, t) for i, t in AWKWARD if i is not None] + [(100 + i, " ".join(words(80, i % 30))) for i in range(90)]
    want = by_hand(rows)
    for df in (docs(spark, rows), clashing(spark, rows)):
        got = lm.score_documents(df, copy_tokens=20_000).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            h, n, known, total, base = want[r.doc_id, texts[r.doc_id]]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6) and r.score < 0


def test_class_probabilities_sum_to_one_and_carry_state():
    rng = np.random.default_rng(0)
    w = lm.start_weights(rng.integers(0, 100, lm.CODES).astype(float))
    w = {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in w.items()}
    prefix = rng.integers(0, lm.CODES, 3 * lm.WINDOW + 5)
    before = lm.log10_codes(w, [prefix])[0]
    each = lm.log10_codes(w, [np.append(prefix, k) for k in range(lm.CODES)]) - before
    assert abs((10 ** each).sum() - 1) < 1e-3
    many = [rng.integers(0, lm.CODES, n) for n in (1, 40, 7, 100, 33, 32)]
    assert np.allclose(lm.log10_codes(w, many), [lm.log10_codes(w, [q])[0] for q in many], atol=1e-3)


def class_of(word, count, head):
    """A word's code by the rule."""
    if word in head:
        return head[word]
    if not count:
        return lm.UNSEEN
    mark = int(chr(word[-1]) in string.punctuation)
    if count == 1 and zlib.crc32(word) & 1:
        return lm._ONCE[mark]
    return lm.HEAD + 1 + 2 * min(count.bit_length() - 1, lm.BANDS - 1) + mark


def test_codes_follow_the_rule(spark):
    head = {lm.END: 0, b"the": 1}
    counts = {lm.END: 5, b"the": 9, b"a": 4, b"b": 5, b"c.": 4, b"once": 1, b"twice,": 1, b"xx": 7, "fin\u00e9".encode(): 1, b"[": 1023,
              b"\\": 1024, b"many-": 2**40} | {b"w%d" % i: 1 for i in range(40)}
    df = spark.createDataFrame([(w, c, head.get(w)) for w, c in counts.items()], "word binary, c long, rank int")
    got = {bytes(r.word): r.k for r in df.select("word", lm.code_of(F.col("c"), F.col("word"), F.col("rank")).alias("k")).collect()}
    assert got == {w: class_of(w, c, head) for w, c in counts.items()}
    plain = lm.for_scoring(np.array([got[b"once"], got[b"w1"], got[b"w2"]], np.uint8))
    assert len(set(plain.tolist())) == 1 and {254, 255} & set(got.values()) and lm.UNSEEN < lm._ONCE[0]


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(2)
    w0 = lm.start_weights(np.ones(lm.CODES))
    seqs = [rng.integers(0, 20, n).astype(np.uint8) for n in (9, 5)]

    def loss(w):
        return -lm.log10_codes(w, [q.astype(np.int64) for q in seqs]).sum() * math.log(10)

    w = {k: v.copy() for k, v in w0.items()}
    lm.Trainer(w, rate=1e-3).learn(seqs)  # one Adam step moves each weight against its gradient's sign
    for k in w:
        moved = w[k] - w0[k]
        at = np.unravel_index(np.argsort(-np.abs(moved).ravel())[:3], moved.shape)
        for place in zip(*at):
            up, down = ({q: x.astype(np.float64).copy() for q, x in w0.items()} for _ in range(2))
            up[k][place] += 1e-3
            down[k][place] -= 1e-3
            slope = loss(up) - loss(down)
            if abs(slope) > 1e-4:
                assert np.sign(slope) == -np.sign(moved[place]), (k, place)


def test_gradients_equal_differences_where_lanes_begin_and_end_in_a_stretch(monkeypatch):
    """Five sequences in two lanes; the first moments after one step are the gradients by one factor."""
    monkeypatch.setattr(lm, "LANES", 2)
    rng = np.random.default_rng(6)
    w0 = lm.start_weights(np.ones(lm.CODES))
    seqs = [rng.integers(0, 40, n).astype(np.uint8) for n in (9, 5, 4, 4, 1)]

    def loss(w):
        return -lm.log10_codes(w, seqs).sum() * math.log(10)

    trainer = lm.Trainer({k: v.copy() for k, v in w0.items()}, rate=1e-3)
    trainer.learn(seqs)
    assert trainer.step == 1 and trainer.seen == 23
    factors = []
    for k, m in lm._views(trainer.m, w0).items():
        for place in zip(*np.unravel_index(np.argsort(-np.abs(m).ravel())[:4], m.shape)):
            up, down = ({q: x.astype(np.float64) for q, x in w0.items()} for _ in range(2))
            up[k][place] += 1e-4
            down[k][place] -= 1e-4
            factors.append((loss(up) - loss(down)) / m[place])
    assert np.allclose(factors, factors[0], rtol=1e-3)


def test_a_stretch_takes_no_fresh_memory():
    """A stretch of all lanes has some 10 MB of values; after the first one they are written where they stood."""
    seqs = [np.random.default_rng(k).integers(0, lm.CODES, 96).astype(np.uint8) for k in range(lm.LANES)]
    w = lm.start_weights(np.ones(lm.CODES))
    trainer, laid = lm.Trainer(w), lm._Lanes(seqs, lm.LANES)
    h = trainer._window(laid, 0, np.zeros((lm.LANES, lm.HIDDEN), np.float32))
    tracemalloc.start()
    try:
        trainer._window(laid, lm.WINDOW, h)
        assert tracemalloc.get_traced_memory()[1] < 2_000_000
    finally:
        tracemalloc.stop()


def test_training_learns_an_order():
    seqs = [np.tile([3, 4, 5, 6], 60).astype(np.uint8) for _ in range(40)]
    w = lm.start_weights(np.ones(lm.CODES))
    start = lm.log10_codes(w, [s.astype(np.int64) for s in seqs]).sum()
    trainer = lm.Trainer(w, rate=0.02)
    for _ in range(20):
        trainer.learn(seqs)
    assert lm.log10_codes(w, [s.astype(np.int64) for s in seqs]).sum() > 0.3 * start


def test_no_training_rows_and_no_rows(spark):
    held = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    assert {(r.train_tokens, r.score, r.n_known) for r in lm.score_documents(docs(spark, held)).collect()} == {(0, 0.0, 0)}
    assert lm.score_documents(docs(spark, held).limit(0)).count() == 0


def test_lanes_hold_every_token_once_and_start_afresh():
    rng = np.random.default_rng(4)
    seqs = [rng.integers(1, lm.CODES, int(n)).astype(np.uint8) for n in rng.integers(1, 300, 500)]
    laid = lm._Lanes(seqs, 16)
    assert sum(laid.active) == sum(map(len, seqs)) and laid.side.shape[1] == 16
    for t, (lanes, which) in laid.starts.items():
        for k, i in zip(lanes, which):
            assert (laid.side[t + 1:t + 1 + len(seqs[i]), k] == seqs[i]).all()
    assert len(laid.active) < 1.2 * sum(map(len, seqs)) / 16 + 300


def plain_score(w, codes, within):
    """The network one token at a time, in double precision."""
    w = {k: v.astype(float) for k, v in w.items()}
    n, h, total, before = lm.HIDDEN, np.zeros(lm.HIDDEN), 0.0, 0
    for y in codes:
        x, a = w["x"][before] + w["b"], h @ w["u"]
        z, r = 1 / (1 + np.exp(-(x[:n] + a[:n]))), 1 / (1 + np.exp(-(x[n:2 * n] + a[n:2 * n])))
        h = z * h + (1 - z) * np.tanh(x[2 * n:] + r * a[2 * n:])
        c, k = divmod(y, lm.MEMBERS)
        for logits, at in ((h @ w["o"] + w["c"], c), (h @ w["q"][c] + w["d"][c], k)):
            total += logits[at] - np.log(np.exp(logits).sum())
        before = y
    return total / math.log(10) + within


def test_score_recomputed_from_the_weights_and_layout_changes_nothing(spark, monkeypatch):
    """Equal scores for 1 and 4 input partitions; each is what the trained weights give one token at a time."""
    rows = [(i, " ".join(words(20 + i % 50, i % 40)) + (" rare%d." % i if i % 4 == 0 else "")) for i in range(150)]
    caught = []
    real = lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda copies, fan=64: caught.append(real(copies, fan)) or caught[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: r.score for r in lm.score_documents(df.repartition(k), copy_tokens=1500).collect()} for k in (1, 4)]
    assert got[0].keys() == got[1].keys() == dict(rows).keys()
    assert all(abs(got[0][i] - got[1][i]) < 1e-3 for i in got[0])
    # codes and shares from plain counts
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*lm.tokens(t), lm.END])
    top = sorted((w for w in count if w != lm.END), key=lambda w: (-count[w], w))[:lm.HEAD]
    head = {lm.END: 0} | {w: i + 1 for i, w in enumerate(top)}
    plain = lambda w: int(lm.for_scoring(np.array([class_of(w, count[w], head)], np.uint8))[0])
    totals = Counter()
    for w, c in count.items():
        totals[plain(w)] += c
    weights = lm._unpack(caught[0], lm.start_weights(np.ones(lm.CODES)))
    for i, t in rows[:40]:
        found = [*lm.tokens(t), lm.END]
        within = sum(math.log10(count[w] / totals[plain(w)]) for w in found if count[w])
        assert abs(plain_score(weights, [plain(w) for w in found], within) - got[0][i]) < 1e-2


def test_registered_values_train_on_every_document(spark, monkeypatch):
    rows = [(i, " ".join(words(30, i % 20))) for i in range(120)]
    seen = []
    real = lm.averaged

    def counted(copies, fan=64):
        seen.append(sum(r.n for r in copies.select("n").collect()))
        return real(copies, fan)

    monkeypatch.setattr(lm, "averaged", counted)
    got = lm.score_documents(docs(spark, rows)).first()
    assert sum(seen) == got.train_tokens
    lm.score_documents(docs(spark, rows), copy_tokens=200).first()
    assert sum(seen) == 2 * got.train_tokens and len(seen) == 2


def test_registered_values_beat_the_base_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm.score_documents(df).where("held_out").groupBy().sum("score", "base_score").first()
    assert row[0] > row[1]


def test_text_ids_that_are_no_numbers_are_null(spark):
    df = spark.createDataFrame([("7", "a b"), ("x", "a c")], "doc_id string, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in lm.score_documents(df).collect()) == [(0, 3), (7, 3)]
