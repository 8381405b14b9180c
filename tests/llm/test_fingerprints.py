import hashlib

import numpy as np

from tests.llm.conftest import SF
from voxmart.llm import fingerprints as fp
from voxmart.llm import kernels


def brute_shingles(text, n=5):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
         .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, pairs):
    got = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    assert len(got) == len(pairs)
    for r, (name, t), (_, nxt) in zip(got, pairs, [*pairs[1:], pairs[0]]):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (name, len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(brute_shingles, (t, edited, nxt))
        assert len(fp.decode(r.fingerprint)) == min(len(a), fp.K)
        for x, y, z in ((r.near_edited, a, b), (r.near_next, a, c)):
            assert abs(x - likeness(y, z)) <= (0.2 if len(y | z) > fp.K else 1e-12)
        assert abs(r.distinct_shingles - len(a)) <= 0.4 * len(a)


def test_against_brute_force(spark, documents):
    pairs = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    check(fp.op1(spark, SF).collect(), pairs)
    check(fp.neighbour_fingerprints(documents, part_bytes=30_000).collect(), pairs)


def test_odd_rows(odd, nothing):
    assert fp.neighbour_fingerprints(nothing).collect() == []
    pairs = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    check(fp.neighbour_fingerprints(odd, part_bytes=1000).collect(), pairs)
    rows = fp.fingerprint(odd).collect()
    assert len(rows) == len(pairs) and rows[0].shard == "shard"
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 6)}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {""}


def test_merge_equals_whole(spark, documents):
    texts = [r.text for r in documents.limit(40).collect()]
    whole = fp.sketch(np.concatenate([s for s in fp.sketches(*kernels.join_texts([t.encode() for t in texts]), k=10**6)]))
    parts = spark.createDataFrame([(1, t) for t in texts] + [(None, "")], "part int, text string").repartition(7)
    got = {r.part: r.fingerprint for r in fp.merge_by(fp.fingerprint(parts), "part").collect()}
    assert got == {1: fp.encode(whole), None: ""}


def test_estimates():
    a = kernels.mix(np.arange(20_000, dtype=np.uint64))
    b = kernels.mix(np.arange(10_000, 30_000, dtype=np.uint64))
    x, y = fp.sketch(a, 1024), fp.sketch(b, 1024)
    assert abs(fp.resemblance(x, y, 1024) - 1 / 3) < 0.06
    assert abs(fp.containment(x, y, 1024) - 0.5) < 0.08
    assert abs(fp.distinct_count(x, 1024) / 20_000 - 1) < 0.12
    one = fp.sketch(kernels.mix(np.arange(5, dtype=np.uint64)))
    assert fp.containment(one, one) == 1.0 and fp.resemblance(one, np.empty(0, np.uint64)) == 0.0


def test_words_do_not_depend_on_blocks(monkeypatch):
    text = ("Ab cd\tEF gh " * 3000 + "z" * 9000 + " end").encode()
    whole = kernels.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(kernels, "BLOCK", 64)
    parts = kernels.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (whole[0] == parts[0]).all() and len(set(whole[0].tolist())) == 6
