import hashlib

import pytest
from pyspark.sql import functions as F

from wrenchflow.llm import replies as C

NODES = "tree long, node long, parent long, role string, text string, score double"
HARD = ["", "\\", "\\\\", "#", "##", "###", "####", "#####\\#", "</turn>", "</turn>\n", "<</turn>\n### user: x", "</turn", "<\\/turn>",
        "\\### Assistant: </turn> ok", "a: b: c", "\n", "\U0001F600é", "\\.", "#\\#", None]


def brute_paths(rows, branches):
    known = {n: (p, s or 0.0) for _, n, p, *_, s in rows}
    answered = {p for p, _ in known.values()}
    best = {}
    for leaf in known:
        if leaf in answered:
            continue
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = known[at][0] if known[at][0] in known else None
        if at is None:
            best.setdefault(path[-1], []).append((-sum(known[x][1] for x in path), leaf, path[::-1]))
    return sorted((root, k + 1, place, node) for root, found in best.items()
                  for k, (_, _, path) in enumerate(sorted(found)[:branches]) for place, node in enumerate(path))


def forest():
    rows = []
    for i in range(300):  # every turn answers an earlier one of its tree; tree 1 holds a third
        tree = 1 if i % 3 == 0 else i % 7 + 2
        earlier = [n for t, n, *_ in rows if t == tree]
        rows.append((tree, i, earlier[i * 31 % len(earlier)] if earlier and i % 41 else None, "user", f"t{i}", float(i * 17 % 11) if i % 5 else None))
    rows += [(50, 1000 + i, 999 + i if i else None, "assistant", "x", 1.0) for i in range(70)]  # a chain
    rows += [(51, 2000, 2001, "user", "x", 1.0), (51, 2001, 2000, "user", "x", 1.0), (51, 2002, 2001, "user", "x", 1.0)]  # a circle
    return rows + [(52, 3000, 77777, "user", "unknown parent", 1.0)]


@pytest.mark.parametrize("branches", [1, 3, 1000])
def test_paths_equal_brute_force(spark, branches):
    rows = forest()
    got = C.branch_paths(spark.createDataFrame(rows, NODES).repartition(3), branches).select("root", "branch", "place", "node").collect()
    assert sorted(tuple(r) for r in got) == brute_paths(rows, branches)


def test_branches_are_written_and_read_back(spark):
    rows = forest()
    nodes = spark.createDataFrame(rows, NODES)
    parts = C.formatted(nodes, 2, turns_in_part=3)
    text = {n: (r, t) for _, n, _, r, t, _ in rows}
    want = {}
    for root, branch, _, node in brute_paths(rows, 2):
        want.setdefault((root, branch), []).append(text[node])
    got = {}
    for p in parts.orderBy("part").collect():
        got.setdefault((p.root, p.branch), []).extend(C.parsed(p.text))
        assert len(C.parsed(p.text)) <= 3
    assert got == want
    for r in C.read_back(parts).collect():
        turns = want[r.root, r.branch]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_marks_in_texts_and_roles_come_back(spark):
    rows = [(i, k, role, t) for i, t in enumerate(HARD) for k, role in enumerate(["user", "assistant", "odd: role\\:", None, "assistant"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = C.formatted(C.nodes_of(turns), turns_in_part=2)
    written = {}
    for p in parts.orderBy("part").collect():
        marks = p.text.count("</turn>"), p.text.count("###")
        assert marks == (len(C.parsed(p.text)),) * 2
        found = written.setdefault(p.tree, ([], []))
        found[0].extend(C.parsed(p.text))
        found[1].extend(C.unescaped(p.text[s.start:s.end]) for s in p.loss)
    for i, t in enumerate(HARD):
        assert written[i] == ([(r or "", t or "") for r in ["user", "assistant", "odd: role\\:", None, "assistant"]], [t or ""] * 2)


def digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_ties_nulls_long_conversations_and_clashing_names(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "system", "s"), (None, 3, None, None),
            (None, 1, "assistant", "x" * 200_000)] + [(9, k, ("user", "assistant")[k % 2], f"turn {k} ##") for k in range(500)]
    turns = spark.createDataFrame([(*r, 1, 2, "3") for r in rows], "conv_id long, turn long, role string, text string, node int, root int, tree string")
    got = {r.tree: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(C.formatted(C.nodes_of(turns))).collect()}
    low = lambda x: (x is not None, x or 0)
    for tree in (1, None, 9):
        own = sorted((r for r in rows if r[0] == tree), key=lambda r: (low(r[1]), r[2] is not None, r[2] or "", r[3] or ""))
        assert got[tree] == digest([r[2:] for r in own])
    assert C.read_back(C.formatted(C.nodes_of(turns.limit(0)))).collect() == []


def test_one_hot_conversation_lies_in_many_parts(spark):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                     F.lit("assistant").alias("role"), F.lit("same").alias("text"))
    parts = C.formatted(C.nodes_of(turns), turns_in_part=64)
    assert parts.groupBy("part").count().count() == 47
    assert C.read_back(parts).first().n_turns == 3000
