"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchflow.llm import (decontaminate, fingerprints, licenses, linededup, lm, packing, quality, ranked, replies, sharding,
                            simhash, toxicity, variants)
from wrenchflow.llm.common import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every whole document, components of links within 3 bits."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_CLASS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_CLASS}') AS w FROM benchmark),
items AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p
             FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM patterns),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT p.doc_id, p.i, p.k, q.item_id FROM places p JOIN patterns q ON p.k = q.k AND p.p = q.p),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op3_decontamination", _OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document inside 13-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents")
    judged = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), out="c", window=13)
    return (judged.select("doc_id", "c.n_words", "c.n_hit", "c.n_items", "c.items_sha256", "c.contaminated"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every whole document; learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         toxicity.score(docs.text, index).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def tokenizer_path() -> str:
    """The vocabulary file of the packing query; it ships with an installed package."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, separator=0)


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of all documents, row counts at most one apart, shuffled reproducibly."""
    placed = sharding.shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op7_document_fingerprints")
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text."""
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole document that repeat an earlier line within 2 edits (one per 20 characters)."""
    return linededup.line_report(table(spark, sf_dir, "documents"), max_edits=2, chars_per_edit=20)


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every whole document by all rules, and the places of the base phrases."""
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document; its source is the host, source and language the path.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out of the labels.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = F.concat_ws("/", docs.source, docs.lang)
    scored = quality.quality(docs, toxicity.training_labels(labels), docs.source, path)
    return scored.withColumn("held_out", toxicity.held_out(F.col("doc_id")))


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole document under unigram counts and the recurrent model."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document with their near words, forms and roots."""
    found = variants.spelling_variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, every=199, factor=5)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM size),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM size) GROUP BY doc_id, n, term),
dfs AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM held GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM dfs, whole),
parts AS (SELECT doc_id, h.term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) AS part
          FROM held h JOIN weights USING (term), whole),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


@query("op12_ranked_search", _OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item, among all documents."""
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


_OP13_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\.') || ': '
                   || replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') || '</turn>' || chr(10) AS line FROM rows),
digests AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                   CAST(sum(length(line)) AS BIGINT) AS formatted_chars
            FROM written GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM digests
"""


@query("op13_chat_formatting", _OP13_SQL)
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's marks, formatted and read back."""
    text = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    nodes = replies.nodes_of(turns.union(extra))
    found = replies.read_back(materialise(replies.formatted(nodes), "chat-parts"))
    return found.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
