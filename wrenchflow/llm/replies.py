"""Chat formatting of reply trees.

A table of turns, each naming the turn it answers, is a forest.  Root-to-leaf
paths are enumerated by iterative self-joins: every round joins each turn's
ancestor pointer with that ancestor's own pointer, so that pointers reach 1, 2, 4,
... turns up; a tree of depth d takes log2(d) rounds.  A turn's score, summed
from the root, ranks the leaves (branches) of a tree; from each chosen leaf the
pointer tables, largest step first, give every turn of its path exactly once.

A turn is written as ``### role: text</turn>`` and a line end.  Inside texts and
roles a backslash is doubled, ``##`` becomes ``#\\#`` and ``</turn>`` becomes
``<\\/turn>`` (in roles also ``:`` becomes ``\\.``), so no text holds a mark, and a
backslash always starts a pair: the writing can be undone.  A path is written in
parts of whole turns, each with the places of its assistant texts (the loss mask).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchflow.llm.common import materialise, shuffle_partitions
from wrenchflow.llm.sharding import numbered

START, END = "### ", "</turn>\n"
_PAIR = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    """The text without a mark of the template in it; null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def unescaped_role(text: str) -> str:
    return _PAIR.sub(lambda m: ":" if m[1] == "." else m[1], text)


def nodes_of(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Turns of plain conversations as a forest: ``tree, node, parent, role, text, score``.

    Each row answers the row before it in its conversation (by turn, then role and
    text; nulls first; repeated rows all stay); rows of a null id are one conversation.
    """
    rows = turns.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"), "role", "text")
    rows = materialise(numbered(rows, ["tree", "turn", "role", "text"]).drop("turn"), "reply-turns")
    first = rows.groupBy("tree").agg(F.min("row_number").alias("first"))
    joined = rows.alias("r").join(first.alias("f"), F.col("r.tree").eqNullSafe(F.col("f.tree")))
    node = F.col("r.row_number")
    return joined.select("r.tree", node.alias("node"), F.when(node > F.col("f.first"), node - 1).alias("parent"),
                         "r.role", "r.text", F.length(F.coalesce("r.text", F.lit(""))).cast("double").alias("score"))


def branch_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of each tree: ``root, branch, place, node``.

    ``nodes`` has ``node, parent, score``: ids without null or repeat (others are left
    out: of repeated ids one row stays); a null or unknown parent makes a root; a null
    score counts 0.  Branches go by their summed score, the smallest leaf first
    among equals, and are numbered from 1; places go from 0 at the root.  Turns that
    answer each other in a circle have no root and stand in no path.
    """
    rows = (nodes.where("node is not null").groupBy("node")
            .agg(F.min(F.struct(F.col("parent").isNull().alias("no"), "parent", "score")).alias("r"))
            .select("node", "r.parent", F.coalesce("r.score", F.lit(0.0)).alias("score")))
    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    answers = rows.where("parent is not null").join(known, "parent", "left")  # roots, many of one null key, stay out of the join
    rows = (answers.select("node", F.when(F.col("known"), F.col("parent")).alias("above"), "score")
            .union(rows.where("parent is null").select("node", F.col("parent").alias("above"), "score")))
    # what each turn knows: the turn `above` it that its pointer has reached, and the steps and score up to there
    reach = materialise(rows.withColumn("depth", F.when(F.col("above").isNull(), 0).otherwise(1))
                        .withColumn("root", F.when(F.col("above").isNull(), F.col("node"))), "reply-reach")
    leaves = reach.select("node").join(reach.select(F.col("above").alias("node")), "node", "left_anti")
    leaves = materialise(leaves, "reply-leaves")
    total, jumps = reach.count(), []
    while not (moving := reach.where("above is not null")).isEmpty() and 2 ** len(jumps) <= total:
        jumps.append(moving.select("node", "above"))
        other = reach.select(F.col("node").alias("above"), F.col("above").alias("higher"), F.col("root").alias("top"),
                             F.col("depth").alias("steps"), F.col("score").alias("gain"))
        further = moving.drop("root").join(other, "above").select(
            "node", F.col("higher").alias("above"), (F.col("score") + F.col("gain")).alias("score"),
            (F.col("depth") + F.col("steps")).alias("depth"), F.col("top").alias("root"))
        reach = materialise(reach.where("above is null").select(*further.columns).union(further), "reply-reach")
    ranked = reach.where("root is not null").join(leaves, "node")
    best = Window.partitionBy("root").orderBy(F.desc("score"), "node")
    paths = materialise(ranked.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
                        .select("root", "branch", F.col("depth").alias("place"), "node"), "reply-paths")
    for k in reversed(range(len(jumps))):
        higher = paths.join(jumps[k], "node").select(
            "root", "branch", (F.col("place") - 2 ** k).alias("place"), F.col("above").alias("node"))
        paths = materialise(paths.union(higher), "reply-paths")
    return paths


def formatted(nodes: DataFrame, branches: int = 1, turns_in_part: int = 64, loss_role: str = "assistant") -> DataFrame:
    """Each chosen path as one conversation: ``tree, root, branch, part, text, loss``.

    The parts' texts in order are the conversation; ``loss`` has the half-open spans of
    code points in the part's text that hold texts of the loss role.  Null
    roles and texts are written as empty ones.  No rows for an empty table.
    """
    paths = branch_paths(nodes, branches)
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\.")), F.lit(": "))
    turns = paths.join(nodes.drop("parent", "score"), "node").select(
        "tree", "root", "branch", F.floor(F.col("place") / turns_in_part).cast("long").alias("part"),
        F.struct("place", head.alias("head"), escaped(F.col("text")).alias("body"),
                 F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("lost")).alias("turn"))
    parts = turns.groupBy("tree", "root", "branch", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["head"])
        end = start + F.length(turn["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(turn["lost"], F.array_append(state["spans"], span))
                        .otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    written = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    return parts.select("tree", "root", "branch", "part", written.alias("text"),
                        F.aggregate("turns", none, add)["spans"].alias("loss"))


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    turns = []
    for piece in text.split(END)[:-1]:
        role, _, body = piece.removeprefix(START).partition(": ")
        turns.append((unescaped_role(role), unescaped(body)))
    return turns


_DIGEST = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Digest:
    """Running digests of one conversation; holds no text."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for role, body in parsed(text):
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
        for s in spans:
            learned = unescaped(text[s["start"]:s["end"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts say: turns, loss text and their digests.

    A digest goes over the parts in order; a task streams them, sorted, and holds
    one part at a time, however long a conversation is.
    """
    spark, kind = parts.sparkSession, parts.schema["tree"].dataType.simpleString()
    order = ["tree", "root", "branch", "part"]
    rows = (parts.repartition(shuffle_partitions(spark), "root", "branch").sortWithinPartitions(*order)
            .select(*order, "text", "loss"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done, trees = None, None, [], None
        for batch in batches:
            trees = batch.schema.field("tree").type
            for tree, root, branch, text, spans in zip(*(batch.column(c).to_pylist()
                                                         for c in ("tree", "root", "branch", "text", "loss"))):
                if (root, branch) != (current and current[1:]):
                    if state:
                        done.append((*current, *state.row()))
                    current, state = (tree, root, branch), _Digest()
                state.add(text, spans)
            if len(done) > 1000:
                yield _rows(done, trees)
                done = []
        if state:
            yield _rows([*done, (*current, *state.row())], trees)

    return rows.mapInArrow(digests, f"tree {kind}, root long, branch int, n_turns long, turns_sha256 string, "
                                    "loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(done: list[tuple], trees: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema([("tree", trees), ("root", pa.int64()), ("branch", pa.int32()), *_DIGEST])
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)
