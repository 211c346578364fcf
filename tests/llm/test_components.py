import random

from wrenchflow.llm.components import components


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, k) for k in range(1000, 1040)] + [(1, 2), (2, 3), (3, 1), (9, 9)]
    edges += [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame([(a, b) if rng.random() < .5 else (b, a) for a, b in edges] * 2, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: find(x) for x in root}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
