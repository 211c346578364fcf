import numpy as np

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import toxicity as X


def labelled(n=400):
    rows, labels = [], []
    for i in range(n):
        w = words(60, i + 1)
        if i % 5 == 0:
            w[10] = w[30] = ("blarg", "snorf", "gruntish")[i // 5 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    return rows, labels


def index_of(spark, n=400, **how):
    rows, labels = labelled(n)
    return X.fit(docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), **how)


def of_texts(texts, toxic):
    """Examples made straight from texts."""
    vocabulary, starts, terms, counts = {}, [0], [], []
    for t in texts:
        for w, n in sorted(X.terms_of(t).items()):
            terms.append(vocabulary.setdefault(w, len(vocabulary)))
            counts.append(n)
        starts.append(len(terms))
    return X.Examples(list(vocabulary), [str(i) for i in range(len(texts))], np.array(toxic), np.array(starts), np.array(terms, int), np.array(counts, int))


def vectors(texts, toxic):
    """Unit TF-IDF vectors by the rule, and the weight of a term, one by one."""
    n, p = len(texts), sum(toxic) / len(texts)
    held = [X.terms_of(t) for t in texts]

    def weight(t):
        a = sum(y for c, y in zip(held, toxic) if t in c)
        df = sum(t in c for c in held)
        rate = (a + 5 * p) / (df + 5)
        bears = 0.05 + max(rate * np.log(rate / p) + (1 - rate) * np.log((1 - rate) / (1 - p)), 0)
        return (np.log((1 + n) / (1 + df)) + 1) * bears

    known = {t: weight(t) for c in held for t in c}

    def vector(text):
        v = {t: (1 + np.log(c)) * known.get(t, weight("\0")) for t, c in X.terms_of(text).items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items() if t in known}
    return [vector(t) for t in texts], vector


def test_nearest_equals_exhaustive_search_and_passes_blocks_over():
    """Examples of four vocabularies: blocks of the other three are never read."""
    texts = [" ".join(f"{'abcd'[i % 4]}{w}" for w in words(40 + i % 30, i + 1)) for i in range(600)]
    toxic = [int(i % 7 == 0) for i in range(600)]
    examples = of_texts(texts, toxic)
    examples = examples.some(examples.together())
    order = [int(n) for n in examples.names]
    index = X.Index(examples, 9)
    held, vector = vectors([texts[i] for i in order], [toxic[i] for i in order])
    for text in [texts[3], texts[50] + " new words", "abo", " ".join("b" + w for w in words(25, 900)), "nothing known", "", None]:
        query = vector(text)
        every = sorted((-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), i) for i, v in enumerate(held))
        want = [(-c, i) for c, i in every if c < 0][:9]
        got = index.nearest(index.vector(text))
        assert np.allclose([c for c, _ in got], [c for c, _ in want])
        assert [i for _, i in got] == [i for _, i in want]
        if got:
            total = sum(c for c, _ in want)
            prior = sum(toxic) / len(toxic)
            assert abs(index.vote(got) - (sum(c * toxic[order[i]] for c, i in want) + 0.5 * prior) / (total + 0.5)) < 1e-9
    assert index.n_blocks == 19 and index.passed > 0.3 * (index.passed + index.read)


def test_ties_go_to_the_earlier_place():
    index = X.Index(of_texts(["one two"] * 50 + ["one three"] * 50, [0, 1] * 50), 30)
    assert [i for _, i in index.nearest(index.vector("one two"))] == list(range(30))


def test_votes_of_a_fold_come_from_the_other_folds():
    texts = [f"{'bad' if i % 3 == 0 else 'good'} w{i} w{i + 1}" for i in range(60)]
    examples = of_texts(texts, [int(i % 3 == 0) for i in range(60)])
    for fold in range(X.FOLDS):
        others = np.flatnonzero(np.arange(60) % X.FOLDS != fold)
        index = X.Index(examples.some(others), 5)
        index._prepare()
        want = []
        for i in range(fold, 60, X.FOLDS):
            terms, w = index.vector(texts[i])
            want.append((index.vote(index.nearest((terms, w / np.sqrt(w @ w)))), int(i % 3 == 0)))
        got = X.fold_votes(examples, fold, 5)
        assert [y for _, y in got] == [y for _, y in want]
        assert len(got) == 12 and all((v > 0.5) == bool(y) for v, y in got)


def test_score_is_the_calibrated_vote(spark):
    index = index_of(spark)
    rows = [(i, " ".join(words(50, 700 + i) + ["snorf"] * (i % 2))) for i in range(30)]
    for r in docs(spark, rows).select("text", X.toxicity(F_text(), index).alias("r"), X.score(F_text(), index).alias("s")).collect():
        vote, near = index.judged(r.text)
        assert r.s == r.r.score == X.calibrated(vote, index.knots) and r.r.vote == vote
        assert [(e.example, e.cosine) for e in r.r.evidence] == [(index.examples.names[i], c) for c, i in near[:5]]


def F_text():
    from pyspark.sql import functions as F
    return F.col("text")


def test_held_out_texts_and_awkward_rows(spark):
    index = index_of(spark)
    fresh = [(1000 + i, " ".join(words(50, 5000 + i) + (["blarg"] if i % 2 else []))) for i in range(40)]
    df = clashing(spark, fresh + AWKWARD)
    got = df.select("doc_id", "text", X.toxicity(df.text, index).alias("r")).collect()
    assert len(got) == len(fresh) + len(AWKWARD)
    for r in got:
        assert 0 <= r.r.score <= 1
        assert (r.r.score >= 0.5) == ("blarg" in (r.text or ""))
        assert bool(r.r.evidence) == bool(r.r.terms)
    kept = X.without_toxic(df, index)
    assert kept.columns == df.columns and kept.count() == 20 + len(AWKWARD)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = docs(spark, AWKWARD)
    index = X.fit(df, none)
    assert {r.r.score for r in df.select(X.toxicity(df.text, index).alias("r")).collect()} == {0.5}
    empty = df.limit(0)
    assert X.without_toxic(empty, X.fit(empty, none)).count() == 0
    one = X.fit(df, spark.createDataFrame([(7, 1), (2, 0), (1, 1)], "doc_id long, toxic int"))
    assert all(0 <= r.s <= 1 for r in df.select(X.score(df.text, one).alias("s")).collect())


def test_every_example_is_held_with_all_its_terms(spark):
    rows = [(i, f"quill{i:c} marsh{i + 1:c} stone") for i in range(97, 117)]  # no term stands in three examples
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    df = docs(spark, rows)
    index = X.fit(df, labels)
    assert sorted(index.examples.names) == sorted(str(i) for i, _ in rows)
    assert {t for _, text in rows for t in X.terms_of(text)} == set(index.examples.vocabulary)
    for r in df.select("doc_id", X.toxicity(df.text, index).alias("r")).collect():
        assert r.r.evidence[0].example == str(r.doc_id) and abs(r.r.evidence[0].cosine - 1) < 1e-6


def test_bounds_in_rows_and_characters(spark):
    index = index_of(spark, max_fit_rows=60)
    assert len(index.examples.names) == 60 and index.examples.toxic.sum() == 30
    small = index_of(spark, max_fit_chars=3000)
    assert 5 <= len(small.examples.names) <= 30


def test_weight_is_smooth_in_the_counts():
    w = X.bearing(np.arange(0, 200.0), np.zeros(200), 0.1)
    assert (w > 0).all() and (np.diff(w) > 0).all() and np.diff(w).max() < 0.5


def test_isotonic_rises():
    knots = X._isotonic([0, 1, 2, 3], [0.1, 0.5, 0.3, 0.9], [10, 10, 10, 10])
    assert [round(y, 3) for _, y in knots] == [0.1, 0.4, 0.9]


def test_real_documents_held_out(spark):
    """Of the held-out rows the toxic ones are found (those whose words occur in training) and clean ones are left alone."""
    d = "/root/testdata/sf0.1"
    df, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    index = X.fit(df, X.training_labels(labels))
    seen = (df.join(labels, "doc_id").where(X.held_out(df.doc_id)).select("toxic", X.score(df.text, index).alias("s"))).collect()
    toxic, clean = ([r.s >= 0.5 for r in seen if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)
