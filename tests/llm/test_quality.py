import zlib

import numpy as np

from tests.llm.conftest import SF
from voxmart.llm import quality


def test_query_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    rows = quality.op8(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    # neither short nor long texts are judged worse
    size = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    middle = np.median([size[r.doc_id] for r in rows])
    for long in (False, True):
        held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label and (size[r.doc_id] > middle) == long]
        good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
        assert np.mean([a > b for a in good for b in bad]) > 0.85


def test_training_sees_every_window(monkeypatch):
    rng = np.random.default_rng(6)
    for n in (0, 5, 6, 517, 518, 6000):
        text = bytes(rng.integers(0, 256, n, np.uint8))
        parts = quality.all_chunks(text)
        seen = [p[i: i + quality.WIDTH] for p in parts for i in range(len(p) - quality.WIDTH + 1)]
        assert seen == [text[i: i + quality.WIDTH] for i in range(n - quality.WIDTH + 1)]
    net, texts = quality.Network(), [quality.all_chunks(bytes(rng.integers(97, 105, n, np.uint8))) for n in (6000, 30, 1500)]
    label, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    whole = net._gradients(texts, label, weight)
    monkeypatch.setattr(quality, "CHUNKS", 2)
    parts = net._gradients(texts, label, weight)
    assert all(np.allclose(whole[k], parts[k]) for k in whole)


def test_maxima_against_brute_force():
    net, rng = quality.Network(), np.random.default_rng(1)
    for n in (0, 1, 5, 6, 7, 512, 517, 518, 1500):
        data = rng.integers(0, 256, n, np.uint8)
        padded = np.concatenate([data, np.zeros(max(0, quality.WIDTH - n), np.uint8)])
        full = np.array([net.p["embed"][padded[i: i + quality.WIDTH]].ravel() @ net.p["conv"]
                         for i in range(len(padded) - quality.WIDTH + 1)]) + net.p["bias"]
        want = np.array([full[i: i + quality.CHUNK].max(axis=0) for i in range(0, len(full), quality.CHUNK)])
        assert np.allclose(net.maxima(data, net.tables()), np.maximum(want, 0), atol=1e-4)


def test_blocks_do_not_change_maxima(monkeypatch):
    net, data = quality.Network(), np.random.default_rng(2).integers(0, 256, 5000, np.uint8)
    whole = net.maxima(data, net.tables())
    monkeypatch.setattr(quality, "BLOCK", 1024)
    assert np.allclose(net.maxima(data, net.tables()), whole)


def test_gradients_match_differences():
    net, rng = quality.Network(), np.random.default_rng(4)
    texts = [[bytes(rng.integers(97, 105, n, np.uint8)) for n in sizes] for sizes in ((40, 30), (25,), (60, 60, 9))]
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = [np.array([net.maxima(np.frombuffer(c, np.uint8), net.tables()).max(axis=0) for c in t]) for t in texts]
        z = np.array([np.concatenate([m.max(axis=0), m.mean(axis=0)]) for m in z]) @ net.p["out"] + net.p["b"][0]
        p = 1 / (1 + np.exp(-z))
        return float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean())

    grads = net._gradients(texts, label, weight)
    for name, spots in (("out", [0, 30]), ("bias", [3, 7]), ("conv", [(2, 3), (20, 11)]), ("embed", [(100, 1), (101, 4)])):
        for at in spots:
            keep, eps = net.p[name][at], 2e-3
            net.p[name][at] = keep + eps
            up = loss()
            net.p[name][at] = keep - eps
            down = loss()
            net.p[name][at] = keep
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 3e-3


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (7, 1), (8, 0), (9, None), (None, 1), (99, 1), (2, 0)],
                                   "doc_id bigint, quality int")
    net = quality.learn(odd, labels)
    rows = quality.judge(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.slot == "slot" for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert {r.score for r in quality.judge(odd, quality.learn(odd, labels.filter("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.judge(odd, quality.learn(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.judge(nothing, net).collect() == [] and quality.keep_good(nothing, labels).collect() == []
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_filter_follows_the_decision(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.op8(spark, sf).collect() if r.predicted == 1}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == good and len(good) < 1000
