import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.util import AWKWARD, clashing, docs, words
from wrenchflow.llm import packing
from wrenchflow.llm.queries import tokenizer_path


def encoder():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


ODD = ["İstanbul ΑΣ Σ. ΌΣΟΣ a.b don't 're, x... A, ... , .", "ǅ ﬁ ª º ʰ 漢字 漢字, ไทย नमस्ते é.", "é a ́b",
       "a<|endoftext|>, <|STARTOFTEXT|> <|startoftext|>.", "dogs' 'tis rock'n'roll it's, 's Ŀ ŉ ß ẞ ÀÉ Œuvre, x_y_ ý. soft\xadhyphen",
       "a\xa0b c\x85d\x1ce\x0bf 12 3,4.", ""]


def test_word_wise_ids_equal_the_tokenizer():
    t, texts = encoder(), ODD + [" ".join(words(300, k)).title() + "." for k in range(5)]
    got = packing.Tokens(tokenizer_path()).of(texts)
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def check_plan(counts, capacity):
    bins = defaultdict(list)
    for n, first, many, per, seq, offset in packing.solve(counts, capacity):
        for rank in range(first, first + many):
            k = rank - first
            bins[seq + k // per].append((offset + k % per * n, n, rank))
    placed = Counter()
    for content in bins.values():
        at = 0
        for offset, n, rank in sorted(content):
            assert offset == at
            at += n
            placed[n, rank] += 1
        assert at <= capacity
    assert placed == Counter((n, r) for n, c in counts.items() for r in range(c))
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 2048])
    counts = Counter(min(capacity, int(rng.paretovariate(0.7)) + rng.randint(0, capacity // 3)) for _ in range(3000))
    total = sum(n * c for n, c in counts.items())
    bins = check_plan(counts, capacity)
    least = max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
    assert bins <= 1.03 * least + 2


def test_large_pieces_pair_at_most_twice():
    assert check_plan({60: 5, 40: 5, 35: 4}, 100) == 7
    assert check_plan({}, 100) == 0
    assert check_plan({100: 3, 1: 250}, 100) == 6


def test_pack_equals_direct_cut(spark):
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, " ".join(words(30 * i, i))) for i in range(40)]
    got = packing.pack(clashing(spark, rows), tokenizer_path(), capacity=256).collect()
    t, want = encoder(), []
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k // 256, k, len(ids[k:k + 256]), zlib.crc32(ids[k:k + 256].tobytes())) for k in range(0, len(ids), 256)]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.05 * sum(w[3] for w in want) / 256 + 2


def test_empty_table(spark):
    assert packing.pack(docs(spark, AWKWARD).limit(0), tokenizer_path()).count() == 0
