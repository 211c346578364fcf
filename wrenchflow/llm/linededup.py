"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines are near copies if their edit distance is at most tau(l), where l is
the shorter one's length and tau(l) = min(max_edits, l div chars_per_edit).  Lengths
of one tau lie in buckets; the lines of a bucket have tau + 1 segments of one
width, the last at the line's end and the others from its start.  Within tau edits
at least one segment stays whole, at a place that its number confines to a few
offsets, whatever the other line's length.  Each distinct line therefore gives
one index key per segment, and for its bucket, near a bucket's start also the one
below, the few substrings that could match (multi-match-aware windows).  Lines that
share a key are candidates unless their lengths or the counts of some common letters
already differ by more than the edits allow, and are verified by the bit-parallel
banded edit distance.

Exact copies are merged first, so copies cost one row; classes are connected
components of the links, kept as (line, root) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.llm.common import materialise
from wrenchflow.llm.components import components

#: Letters counted by the candidate filter.
_COUNTED = "aeinorsthdlucmgp"
#: Lengths of a bucket, or as many as the edits if those are more.
BUCKET = 5
#: Above this many candidate lines their texts are fetched by a shuffle instead of a broadcast of ids.
BROADCAST_ROWS = 2_000_000


def _keys(lines: DataFrame, max_edits: int, chars_per_edit: int, probe: bool) -> DataFrame:
    """(key, id, size, counts): per line a hash of (bucket, segment, substring) for each place to index or probe.

    A line probes its own bucket and, if a line shorter by tau or less may lie below it, that one.
    The places are a short literal that is exploded before any substring is taken,
    so each row computes one key.
    """
    width = max(BUCKET, max_edits)
    places = [(tau, back, i, off) for tau in range(1, max_edits + 1) for back in ((0, tau) if probe else (0,))
              for i in range(tau + 1) for off in (range(-min(i, tau - i), i + 1) if probe and i < tau else (0,))]
    literal = F.array(*[F.struct(F.lit(tau + 1).alias("cuts"), F.lit(back).alias("back"), F.lit(i).alias("i"),
                                 F.lit(off).alias("off"), F.lit(tau * chars_per_edit).alias("low"),
                                 F.lit(2**30 if tau == max_edits else (tau + 1) * chars_per_edit).alias("high"),
                                 F.lit(2**30 if tau == max_edits else max(chars_per_edit // width, 1) - 1).alias("last"))
                        for tau, back, i, off in places])
    rows = (lines.select("id", "line", "size", "counts", F.explode(literal).alias("p"))
            .select("id", "line", "size", "counts", "p.*")
            .withColumn("length", F.expr("if(back = 0, size, greatest(size - back, low))"))
            .where("length >= low and length < high and length <= size"))

    def base(length: str) -> Column:
        return F.expr(f"low + least(cast(({length} - low) div {width} as int), last) * {width}")

    rows = (rows.withColumn("base", base("length"))
            .where((F.col("back") == 0) | (F.col("size") >= F.col("high")) | (F.col("base") < base("size")))
            .withColumn("width", F.expr("cast(base div cuts as int)"))
            .withColumn("start", F.expr("if(i = cuts - 1, size - width, i * width + off)"))
            .where("start >= 0 and start + width <= size"))
    key = F.xxhash64("base", "i", F.substring("line", F.col("start") + 1, F.col("width")))
    return rows.select(key.alias("key"), "id", "size", "counts")


def _letter_counts(line: Column) -> Column:
    """Counts of sixteen letters (modulo 16), four bits each in one long."""
    total = F.lit(0).cast("long")
    for k, letter in enumerate(_COUNTED):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))) % 16
        total = total.bitwiseOR(F.shiftleft(n.cast("long"), 4 * k))
    return total


def _counts_apart(a: Column, b: Column) -> Column:
    """Sum of the differences of the counts (round 16); an edit changes it by 2 at most."""
    total = F.lit(0)
    for k in range(len(_COUNTED)):
        d = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)))
        total = total + F.least(d, 16 - d)
    return total


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of ``a`` and ``b`` where it is at most ``k``, else more than ``k``.

    ``a`` has more than k and ``b`` as many to k more characters.  Bit-vectors of
    the 2k+1 cells around the diagonal go over ``b`` one character at a time: the
    sum in ``d0`` carries matches along the band, and the score follows the band's
    lower edge until it meets the last row, then that row.
    """
    width = 2 * k + 1
    ones = F.lit((1 << width) - 1).cast("long")

    def low_bit(v: Column, place: Column) -> Column:
        return F.call_function("shiftright", v, place).bitwiseAND(F.lit(1))

    def distance(pair: Column) -> Column:
        def matches(y: Column, i: Column) -> Column:
            bits = F.lit(0).cast("long")
            for t in range(width):
                bits = bits + F.when(F.get(pair["a"], i + (t - k)) == y, F.lit(1 << t)).otherwise(F.lit(0))
            return F.struct(bits.alias("x"), (i - pair["m"] + k).alias("past"))

        def step(s: Column, e: Column) -> Column:
            x, vp, vn = e["x"], s["vp"], s["vn"]

            def with_d0(d0: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(ones)
                hn = d0.bitwiseAND(vp)
                half = F.shiftright(d0, 1)
                row = (F.lit(width - 2) - e["past"]).cast("int")
                change = F.when(e["past"] < 0, 1 - low_bit(d0, F.lit(width - 1))).otherwise(low_bit(hp, row) - low_bit(hn, row))
                return F.struct(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(ones).alias("vp"),
                                half.bitwiseAND(hp).alias("vn"), (s["score"] + change).cast("long").alias("score"))

            d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(ones)
            return F.transform(F.array(d0), with_d0)[0]

        start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"),
                         F.lit(k).cast("long").alias("score"))
        return F.aggregate(F.transform(pair["b"], matches), start, step, lambda s: s["score"])

    # one-element arrays hold what is used more than once
    pair = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("m"))
    return F.transform(F.array(pair), distance)[0]


def _blank(line: str | Column) -> Column:
    """Nothing but ASCII white space."""
    return F.trim(line, F.lit(" \t\r\f\x0b")) == ""


def distinct_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored ``(id, line, n, size, counts)``, one row per distinct line that isn't blank."""
    lines = (docs.select(F.explode(F.split(docs[text_col], "\n", -1)).alias("line"))
             .where(~_blank("line")).groupBy("line").agg(F.count("*").alias("n")))
    return materialise(lines.select(F.monotonically_increasing_id().alias("id"), "line", "n", F.length("line").alias("size"),
                                    _letter_counts(F.col("line")).alias("counts")), "lines")


def candidates(lines: DataFrame, max_edits: int = 2, chars_per_edit: int = 20) -> DataFrame:
    """Pairs ``(a, b)`` of line ids, ``a`` not longer than ``b``, that share a segment and may be near."""
    sized = lines.where(F.col("size") >= chars_per_edit)
    index = _keys(sized, max_edits, chars_per_edit, probe=False).select(
        "key", F.col("id").alias("a"), F.col("size").alias("a_size"), F.col("counts").alias("a_counts"))
    probe = _keys(sized, max_edits, chars_per_edit, probe=True).select(
        "key", F.col("id").alias("b"), F.col("size").alias("b_size"), F.col("counts").alias("b_counts"))
    longer_by, tau = F.col("b_size") - F.col("a_size"), F.least(F.lit(max_edits), F.expr(f"a_size div {chars_per_edit}"))
    near = _counts_apart(F.col("a_counts"), F.col("b_counts")) <= 2 * max_edits
    return (index.join(probe, "key").where((longer_by >= 0) & (longer_by <= tau) & ((longer_by > 0) | (F.col("a") < F.col("b"))) & near)
            .select("a", "b").distinct())


def near_links(lines: DataFrame, max_edits: int = 2, chars_per_edit: int = 20) -> DataFrame:
    """Verified links ``(u, v)`` between distinct lines within their edits of each other."""
    pairs = materialise(candidates(lines, max_edits, chars_per_edit), "line-candidates")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    if pairs.count() <= BROADCAST_ROWS:  # two ids a pair
        ids = F.broadcast(ids)
    texts = materialise(lines.join(ids, "id", "left_semi").select("id", "line"), "line-texts")
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("a_line")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("b_line")), "b"))
    allowed = F.least(F.lit(max_edits), F.floor(F.length("a_line") / chars_per_edit))
    near = both.where(edit_distance(F.col("a_line"), F.col("b_line"), max_edits) <= allowed)
    return near.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _hashes(line: str) -> list[Column]:
    """128 bits that stand for a line where its text isn't needed."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), F.col(line)).alias("h2")]


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2,
                   chars_per_edit: int = 20) -> DataFrame:
    """Lines to remove, one row each: ``doc_id, text_hash, pos, first_id, near``.

    Of each class of equal and near lines the first occurrence stays: the one of
    the least id (null ids last), text hash and position; ``first_id`` is its
    document.  ``near`` marks lines whose class holds another text.  Blank lines
    are no lines; null texts have none; rows alike in id and text are one document.
    """
    lines = distinct_lines(docs, text_col)
    classes = materialise(components(near_links(lines, max_edits, chars_per_edit), "line"), "line-classes")
    known = (lines.join(classes, lines["id"] == classes["node"], "left").where("n > 1 or root is not null")
             .select(*_hashes("line"), F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("near")))
    known = materialise(known, "line-repeats")
    places = (docs.select(F.col(id_col).alias("doc_id"), _text_hash(docs[text_col]).alias("text_hash"),
                          F.posexplode(F.split(docs[text_col], "\n", -1)).alias("pos", "line"))
              .where(~_blank("line")).select("doc_id", "text_hash", "pos", *_hashes("line")))
    found = materialise(places.join(known, ["h1", "h2"]).select("doc_id", "text_hash", "pos", "root", "near"), "line-places")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos")
    first = materialise(found.groupBy("root").agg(F.min(place).alias("first")), "line-firsts")
    return (found.join(first, "root").where(~place.eqNullSafe(F.col("first")))
            .select("doc_id", "text_hash", "pos", F.col("first.doc_id").alias("first_id"), "near").distinct())


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2,
                chars_per_edit: int = 20) -> DataFrame:
    """Per document row: ``doc_id, n_lines, n_removed, n_near, removed, first_ids``.

    ``removed`` holds the positions (from 0) of removed lines, ``first_ids`` the
    documents that keep their first occurrences.
    """
    gone = (repeated_lines(docs, id_col, text_col, max_edits, chars_per_edit).groupBy("doc_id", "text_hash")
            .agg(F.sort_array(F.collect_list("pos")).alias("removed"), F.count_if("near").alias("n_near"),
                 F.sort_array(F.collect_set("first_id")).alias("first_ids"))
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "removed", "n_near", "first_ids"))
    lines = F.filter(F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1), lambda x: ~_blank(x))
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_hash(docs[text_col]).alias("text_hash"),
                       F.size(lines).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return (rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["text_hash"] == gone["__hash"]), "left")
            .select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.coalesce("removed", none).alias("removed"),
                    F.coalesce("first_ids", none.cast("array<long>")).alias("first_ids")))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           length_col: str | None = None, max_edits: int = 2, chars_per_edit: int = 20) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; every row and column stays.

    ``length_col``, if given, is set to the new text's characters.  A document all
    of whose lines stand elsewhere keeps its blank lines or an empty text.
    """
    gone = (repeated_lines(docs, id_col, text_col, max_edits, chars_per_edit).groupBy("doc_id", "text_hash")
            .agg(F.collect_list("pos").alias("__gone"))
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone"))
    rows = docs.withColumn("__text_hash", _text_hash(docs[text_col]))
    rows = rows.join(gone, rows[id_col].eqNullSafe(gone["__id"]) & (rows["__text_hash"] == gone["__hash"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))  # by hash, not line by line
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(F.array(lines), lambda x: F.transform(kept, lambda i: F.get(x, i)))[0], "\n"))
    rows = rows.withColumn(text_col, text)
    if length_col:
        rows = rows.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return rows.select(*docs.columns)
