import math
import random

from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import quality as Q
from wrenchflow.llm.toxicity import held_out, training_labels


def score(df, labels):
    return Q.quality(df, labels, F.col("source") if "source" in df.columns else F.lit("h"),
                     F.concat_ws("/", F.col("source"), F.col("lang")) if "source" in df.columns else F.lit("h/p"))


def test_ratios(spark):
    df = spark.createDataFrame([("Ab c1, d#\n\nAb c1, d#",), ("",), (None,)], "text string")
    a, b, c = [r.r for r in df.select(Q.ratios(F.col("text")).alias("r")).collect()]
    n = len("Ab c1, d#\n\nAb c1, d#")
    assert (a.symbols, a.capitals, a.digits, a.marks) == (2 / n, 2 / n, 2 / n, 2 / n)
    assert (a.short_words, a.distinct_words, a.distinct_lines) == (1.0, 0.5, 0.5)
    assert b == c and not any(b)


def test_sparse_sites_shrink_toward_the_corpus(spark):
    rows = [(i, " ".join(words(30, i)), "en", ("good" if i < 200 else "bad") if i < 400 else "tiny", 1) for i in range(402)]
    labels = [(i, int(i < 200 or i % 4 == 0)) for i in range(402)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.host: r.host_rate for r in score(df, spark.createDataFrame(labels, "doc_id long, quality int")).select("host", "host_rate").distinct().collect()}
    share = sum(y for _, y in labels) / 402
    assert got["good"] > 0.98 and abs(got["bad"] - 0.25) < 0.03
    assert min(0.5, share) - 0.2 < got["tiny"] < 0.75


def test_awkward_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for df in (docs(spark, AWKWARD), clashing(spark, AWKWARD), docs(spark, [(i, t) for i, t in AWKWARD]).withColumn("source", F.lit(None).cast("string"))):
        got = score(df, labels).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {round(r.score, 6) for r in score(docs(spark, AWKWARD), none).collect()} == {0.5}
    assert score(docs(spark, AWKWARD).limit(0), labels).count() == 0


def test_real_documents_held_out(spark):
    d = "/root/testdata/sf0.01"
    df, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = score(df, training_labels(labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def brute(rows, labels):
    """Posteriors, weights and scores from the documents' bins, by plain loops over (doc_id, host, path, bins)."""
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = min(known.get(i, 1), y)
    seen = [(b, known[i]) for i, _, _, b in rows if i in known]
    n, p = len(seen), sum(y for _, y in seen)
    share = (p + 1) / (n + 2)
    odds = {}
    for b, y in seen:
        for k, v in enumerate(b):
            a = odds.setdefault((k, v), [0, 0])
            a[y] += 1
    odds = {kv: math.log((good + 1) / (p + 8) / ((bad + 1) / (n - p + 8))) for kv, (bad, good) in odds.items()}
    evidence = lambda b: sum(odds.get((k, v), 0.0) for k, v in enumerate(b))
    base = math.log(share / (1 - share))

    def loss(w):
        s = [min(max(sigmoid(base + w * evidence(b)), 1e-6), 1 - 1e-6) for b, _ in seen]
        return sum(-math.log(x if y else 1 - x) for x, (_, y) in zip(s, seen))
    weight = min([0.1, 0.2, 0.3, 0.5, 0.7, 1.0], key=loss)
    doc = {id(r): sigmoid(base + weight * evidence(r[3])) for r in rows}
    paths, hosts = {}, {}
    for r in rows:
        good = known[r[0]] if r[0] in known else doc[id(r)]
        for table, key in ((paths, (r[1], r[2])), (hosts, r[1])):
            held = table.setdefault(key, [0, 0.0])
            held[0] += 1
            held[1] += good
    overall = (sum(g for _, g in hosts.values()) + 0.5) / (len(rows) + 1)

    def strength(sites, of):
        spread = sum(k * (g / k - of(s)) ** 2 for s, (k, g) in sites.items() if k > 1)
        noise = sum(of(s) * (1 - of(s)) for s, (k, g) in sites.items() if k > 1)
        room = sum((k - 1) * of(s) * (1 - of(s)) for s, (k, g) in sites.items() if k > 1)
        excess = max((spread - noise) / room, 0)
        return min(max((1 - excess) / excess if excess else 1e6, 1.0), 1e6)
    m = strength(hosts, lambda s: overall)
    host_rate = {s: (g + m * overall) / (k + m) for s, (k, g) in hosts.items()}
    m = strength(paths, lambda s: host_rate[s[0]])
    path_rate = {s: (g + m * host_rate[s[0]]) / (k + m) for s, (k, g) in paths.items()}
    out = {}
    for r in rows:
        rate = min(max(path_rate[r[1], r[2]], 1e-6), 1 - 1e-6)
        score = sigmoid(math.log(rate / (1 - rate)) + weight * evidence(r[3]))
        out[r[0]] = doc[id(r)], host_rate[r[1]], path_rate[r[1], r[2]], score
    return out


def test_posteriors_and_scores_equal_plain_loops(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        host = rng.choice(["a", "a", "a", "b", "c", "d", f"h{i % 17}"])
        text = " ".join(words(rng.randint(1, 60), i)) + rng.choice(["", "!!! $$$ %%% " * rng.randint(1, 9), "\n\n" + "AB 12 " * 5])
        rows.append((i, text, rng.choice(["en", "de"]), host, 1))
    labels = [(i, int(rng.random() < (0.8 if "$" not in t else 0.2))) for i, t, *_ in rows if i % 3] + [(4, 0), (None, 1), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = F.concat_ws("/", F.col("source"), F.col("lang"))
    made = [(r.doc_id, r.source, r.path, list(r.b)) for r in
            df.select("doc_id", "source", path.alias("path"), Q.bins(Q.ratios(F.col("text"))).alias("b")).collect()]
    want = brute(made, labels)
    got = Q.quality(df, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("source"), path).collect()
    assert len(got) == len(rows)
    for r in got:
        for value, expected in zip((r.doc_score, r.host_rate, r.path_rate, r.score), want[r.doc_id]):
            assert abs(value - expected) < 1e-9
        assert r.predicted == int(r.score >= 0.5)
