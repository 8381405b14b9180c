import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tests.llm.test_decontamination import words
from voxmart.llm import language_model as lm


def brute(docs, rounds=lm.ROUNDS):
    """Rows of the query, with EM on every occurrence's own estimates."""
    held = [d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    streams = [[*words(t), "\n"] for _, t in docs]
    one, two = Counter(), Counter()
    for h, s in zip(held, streams):
        if not h:
            one.update(s)
            two.update(zip(["\n", *s], s))
    n, v = sum(one.values()), len(one)
    pair = two
    size = lambda a: one[a]
    bucket = lambda a: one[a].bit_length()
    weights = {}
    for k in {None, *(bucket(a) for a, _ in pair)}:
        rows = [(c, 0 if k is None else (c - 1) / max(1, size(a) - 1), (one[b] - 1) / max(1, n - 1), 1 / (v + 1))
                for (a, b), c in pair.items() if k is None or bucket(a) == k]
        w = np.full(3, 1 / 3) if rows else np.array([0, 0, 1.0])
        f, c = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
        for _ in range(rounds if rows else 0):
            p = f * w
            w = (p / p.sum(axis=1, keepdims=True) * c[:, None]).sum(axis=0)
            w /= w.sum()
        w = np.maximum(w, [0, 0, 1e-6])
        weights[k] = w / w.sum()
    out = []
    for (d, _), h, s in zip(docs, held, streams):
        total = 0.0
        for a, b in zip(["\n", *s], s):
            w = weights.get(bucket(a), weights[None])
            total += math.log10(w[0] * (pair[a, b] / size(a) if pair[a, b] else 0) + w[1] * one[b] / max(1, n) + w[2] / (v + 1))
        out.append((d, h, len(s), sum(b in one for b in s), n, sum(math.log10((one[b] + 1) / (n + v + 1)) for b in s), total))
    return out


def close(got, want, loose=0.02):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-9 * max(1, -w[5]) and abs(g[6] - w[6]) <= loose * max(1, -w[6])


@pytest.mark.parametrize("known, hot", [(1 << 18, 512), (200, 512), (200, 8), (0, 0)])
def test_against_brute_force(spark, documents, monkeypatch, known, hot):
    """Every context keeps its own counts, however many words the tasks know."""
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "RECORDS", 5000)
    docs = documents.filter("doc_id < 60").select("doc_id", lm.held_out().alias("held_out"), F.col("text").alias("t"))
    rows = lm.score(docs, *lm.learn(docs, known)).collect()
    close(rows, brute([(r.doc_id, r.t) for r in docs.collect()]))


def test_query(spark):
    rows = lm.op6(spark, SF.replace("0.001", "0.01")).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len({r.train_tokens for r in rows}) == 1


def test_odd_rows(spark, odd, nothing):
    for df in (odd, nothing, odd.filter("doc_id = 2")):
        docs = df.select("doc_id", lm.held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("t"))
        rows = lm.score(docs, *lm.learn(docs)).collect()
        close(rows, brute([(r.doc_id, r.t) for r in docs.collect()]))
