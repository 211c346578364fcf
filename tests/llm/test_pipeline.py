import corpus_pipeline as C
from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, DOCS, clashing
from wrenchflow.llm import toxicity
from wrenchflow.llm.decontaminate import contamination
from wrenchflow.llm.packing import pack
from wrenchflow.llm.queries import QUERIES, SQL, tokenizer_path
from wrenchflow.llm.simhash import simhash_groups

D = "/root/testdata/sf0.01"  # 200 documents have too few toxic labels to learn from


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_run_equals_its_stages_and_each_stage_does_what_it_says(spark):
    """Every stage against a plain reading of its rule, on all that its predecessor kept; the last equals ``run``."""
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, kept[-1], D).checkpoint() if name != "best-fit packing" else stage(spark, kept[-1], D)
        if name != "best-fit packing":
            assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
        kept.append(out)
    clean, lines, single, honest, packed = kept[1:]

    index = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{D}/labels.parquet")))
    texts = {r.doc_id: r for r in docs.collect()}
    judged = {i: toxicity.calibrated(index.judged(r.text)[0], index.knots) for i, r in texts.items()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, s in judged.items() if s < 0.5}
    assert 0 < clean.count() < len(texts)

    after = {r.doc_id: r for r in lines.collect()}
    assert after.keys() == {r.doc_id for r in clean.select("doc_id").collect()}
    counted, first = {}, {}
    for i in sorted(after):
        left = iter((texts[i].text or "").split("\n"))
        own = (after[i].text or "").split("\n") if after[i].text else []
        assert all(any(x == y for y in left) for x in own)  # lines are only taken out
        assert after[i].n_chars == len(after[i].text or "") or after[i].text is None
        for x in own:
            if x.strip():
                counted[x] = counted.get(x, 0) + 1
                first.setdefault(x, i)
    assert max(counted.values()) == 1
    assert {x for i in after for x in (texts[i].text or "").split("\n") if x.strip() and len(x) < 20} == {x for x in counted if len(x) < 20}

    groups = simhash_groups(lines, shingle=3, radius=3).select("doc_id", "component_id").collect()
    assert {r.doc_id for r in single.select("doc_id").collect()} == {r.component_id for r in groups}

    verdict = contamination(single, spark.read.parquet(f"{D}/benchmark.parquet"), out="c").select("doc_id", "c.contaminated").collect()
    assert {r.doc_id for r in honest.select("doc_id").collect()} == {r.doc_id for r in verdict if not r.contaminated}

    assert rows_of(packed.drop("sequence_id", "offset")) == rows_of(pack(honest, tokenizer_path(), capacity=2048, separator=0).drop("sequence_id", "offset"))
    whole = C.run(spark, D)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows_of(whole.drop("sequence_id", "offset")) == rows_of(packed.drop("sequence_id", "offset"))
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 2048 or n <> end").isEmpty()


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, blanks, repeated rows and a very long text go through; an empty table gives no rows."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in AWKWARD]
    for name, docs in (("some", rows), ("none", [])):
        base = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, DOCS).write.parquet(f"{base}/documents.parquet")
        for other in ("benchmark", "labels"):
            spark.read.parquet(f"{D}/{other}.parquet").write.parquet(f"{base}/{other}.parquet")
        got = C.run(spark, base).collect()
        if docs:
            kept = {r.doc_id for r in got}
            assert {4, 6, 7} <= kept and not {5} & kept  # 5 repeats the text of 4: its line went, then its empty text joined the blanks
            assert sum(r.length for r in got if r.doc_id == 6) > 2048
        else:
            assert got == []


def test_extra_columns_pass_through(spark):
    docs = clashing(spark, [(1, "one two three"), (2, None), (None, "x")]).withColumnRenamed("score", "n_chars")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns[:2] == ["doc_id", "text"] and "root" in docs.columns


def test_queries_are_named_after_their_number():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(SQL) <= set(QUERIES)
