import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from voxmart.llm import token_files as tf
from voxmart.llm import tokens
from voxmart.session import scratch_path

PATH = tokens.public("word_bpe_49k.json")


def expected(docs):
    lib, at, out = Tokenizer.from_file(PATH), 0, []
    for name, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode())):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((name, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query(spark, documents):
    want = expected([(r.doc_id, r.text) for r in documents.collect()])
    assert got(tf.op4(spark, SF)) == want
    folder = scratch_path(spark, "test-files")
    manifest = tf.write(documents, PATH, folder, shard=5000, part_bytes=100_000)
    assert manifest.count() > 20
    assert got(tf.read(manifest, folder)) == want
    rows = tf.read(manifest, folder, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 2), (513, 2), (3000, 7), (2000, 70_000), (4096, 49_408)])
def test_queries_of_a_file(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    if n > 2000:
        ids[100:400] = 3
    raw = tf.build(ids, [5, None], [n // 2, n - n // 2])
    f = tf.WaveletFile(raw)
    assert (f.ids() == ids).all() and f.documents == [(5, n // 2), (None, n - n // 2)]
    for i in [*range(0, n, 97), *range(max(0, n - 3), n)]:
        assert f.access(i) == ids[i]
    for t in {*ids[:10].tolist(), 3, top + 5, 1 << 20}:
        where = np.flatnonzero(ids == t).tolist()
        assert f.count(t) == len(where) and f.count(t, n // 3, n // 2) == sum(n // 3 <= w < n // 2 for w in where)
        for i in (0, 1, n // 2, n):
            assert f.rank(t, i) == sum(w < i for w in where)
        assert [f.select(t, k) for k in range(min(len(where), 25))] == where[:25]
        with pytest.raises(IndexError):
            f.select(t, len(where))
    with pytest.raises(IndexError):
        f.access(n)


def test_a_file_is_smaller_than_its_ids():
    ids = np.minimum(np.random.default_rng(1).zipf(1.2, 200_000), 40_000).astype("<u4")
    assert len(tf.build(ids, [1], [len(ids)])) < 0.5 * ids.nbytes


def test_odd_rows(spark, odd, nothing):
    folder = scratch_path(spark, "test-files")
    assert got(tf.read(tf.write(odd, PATH, folder, shard=50, part_bytes=10_000), folder)) == \
        expected([(r.doc_id, r.text) for r in odd.collect()])
    folder = scratch_path(spark, "test-files")
    assert tf.read(tf.write(nothing, PATH, folder), folder).collect() == []
