import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from voxmart.llm import packing, tokens

PATH = tokens.public("byte_bpe_50k.json")


def check(rows, docs, capacity=1024):
    """Every id is in place once; returns how many sequences there are."""
    lib = Tokenizer.from_file(PATH)
    want = Counter()
    for name, text in docs:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[name, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark, documents):
    rows = packing.op3(spark, SF).collect()
    n = check(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert n <= packing.bounds(Counter(r.length for r in rows), 1024) + 1


def optimum(sizes, capacity):
    @lru_cache(None)
    def go(left):
        if not left:
            return 0
        top, rest, best = left[-1], left[:-1], len(left)
        for mask in range(1 << len(rest)):
            inside = [s for i, s in enumerate(rest) if mask >> i & 1]
            if sum(inside) + top <= capacity:
                best = min(best, 1 + go(tuple(s for i, s in enumerate(rest) if not mask >> i & 1)))
        return best

    return go(tuple(sorted(sizes)))


def test_small_cases_are_optimal():
    rng = random.Random(2)
    for _ in range(120):
        sizes = [rng.randint(1, 20) if rng.random() < 0.3 else rng.randint(5, 14) for _ in range(rng.randint(1, 9))]
        plan = packing.complete(Counter(sizes), 20)
        assert sorted(s for p, m in plan for s in p * m) == sorted(sizes) and all(sum(p) <= 20 for p, _ in plan)
        assert sum(m for _, m in plan) == optimum(sizes, 20)


def test_better_than_best_fit():
    counts = {6: 6, 5: 6, 4: 6, 3: 6, 2: 6}
    counts = {s: c for s, c in counts.items()}
    assert sum(m for _, m in packing.complete(counts, 10)) == 12 == packing.bounds(counts, 10)
    for seed in range(4):
        rng = np.random.default_rng(seed)
        counts = Counter(np.clip(rng.lognormal(5.5, 1, 50_000).astype(int), 1, 1024).tolist())
        plan = packing.complete(counts)
        assert Counter({s: sum(m * p.count(s) for p, m in plan if s in p) for s in counts}) == counts
        got = sum(m for _, m in plan)
        assert got <= min(packing.bounds(counts, 1024) * 1.001, sum(m for _, m in packing.best_fit(counts, 1024)))
    with pytest.raises(ValueError):
        packing.complete({1025: 1})
    assert packing.complete({}) == []


def test_odd_rows(spark, odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for group in (1, 200_000):
        check(packing.pack(odd, PATH, group=group).collect(), docs)
    assert packing.pack(nothing, PATH).collect() == []
    packed = packing.pack(odd, PATH, with_ids=True)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset: r.offset + r.length].tobytes() == bytes(r.ids)
