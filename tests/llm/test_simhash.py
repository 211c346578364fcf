import numpy as np
import pytest
import xxhash

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import simhash


def by_hand(text, k=3):
    w = [x for x in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
         .translate({c: " " for c in range(9, 14)}).split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_equals_plain_count():
    for t in [None, "", "One", "One two", "A b C", "a\x0bb\x1cc d e f", " ".join(words(500))]:
        assert simhash.fingerprint(t) == by_hand(t), t


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    table = simhash.masks(radius)
    assert len(table) == 2 ** (radius + 1) - 1
    rng = np.random.default_rng(1)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(diff & m == 0 for m in table)


def brute_groups(rows, radius=3):
    fps = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min([x for x in (least.get(g), d) if x is not None], default=None)
    return sorted(((d, f, least[g]) for (d, _), f, g in zip(rows, fps, group)), key=str)


def near_rows():
    base = words(300, 3)
    rows = [(i, " ".join(words(40, i))) for i in range(20, 40)]
    for i in range(12):
        w = list(base)
        w[i * 7] = "changed"
        rows.append((100 - i, " ".join(w)))
    return rows + AWKWARD


def test_groups_equal_brute_force(spark):
    rows = near_rows()
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs(spark, rows)).collect()), key=str)
    assert got == brute_groups(rows)
    split = simhash.simhash_groups(docs(spark, rows), split_above=1).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in split), key=str) == got


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    kept = simhash.drop_near_copies(clashing(spark, rows)).collect()
    groups = {}
    for d, f, c in brute_groups(rows):
        groups.setdefault((c, None) if c is not None else (None, f), []).append(d)
    assert len(kept) == len(groups)
    assert sorted([r.doc_id for r in kept], key=str) == sorted([c for c, _ in groups], key=str)
    assert kept[0].asDict().keys() == set(clashing(spark, rows).columns)


def test_empty_table(spark):
    assert simhash.simhash_groups(docs(spark, AWKWARD).limit(0)).count() == 0
    assert simhash.drop_near_copies(docs(spark, AWKWARD).limit(0)).count() == 0
