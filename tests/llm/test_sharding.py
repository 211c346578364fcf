import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, clashing, docs
from wrenchflow.llm import sharding as S


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 1000, 65537])
def test_permutation_is_a_bijection_with_inverse(n):
    for seed in (0, 7):
        p = S.permute(np.arange(n), n, seed)
        assert sorted(p.tolist()) == list(range(n))
        assert (S.permute(p, n, seed, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (S.permute(np.arange(n), n, 0) != S.permute(np.arange(n), n, 1)).mean() > 0.9


def test_shards_are_even_gapless_and_computable(spark):
    rows = AWKWARD + [(i, f"text {i % 50}") for i in range(100, 400)]
    got = S.shards(clashing(spark, rows), 24).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    place = S.permute(np.arange(len(rows)), len(rows))
    assert all((r.shard, r.slot) == (place[r.row_number] % 24, place[r.row_number] // 24) for r in got)
    order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in sorted(got, key=lambda r: r.row_number)]
    assert order == sorted(order)


def test_same_shards_whatever_the_partitions(spark):
    rows = [(i, f"text {i}") for i in range(200)]
    a, b = (S.shards(docs(spark, rows).repartition(k, F.rand()), 24).collect() for k in (2, 7))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_few_rows_and_no_rows(spark):
    assert {r.slot for r in S.shards(docs(spark, AWKWARD[:2]), 24).collect()} == {0}
    assert S.shards(docs(spark, AWKWARD).limit(0), 24).count() == 0
