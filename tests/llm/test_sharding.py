import hashlib
from collections import defaultdict

import pytest
from check import compare, oracle_connection

from tests.llm.conftest import SF
from voxmart.llm import catalog, sharding


def brute(rows, limit):
    """Buckets split in two until they fit."""
    out, todo = {}, [(0, 0, [(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), k, n) for k, n in rows])]
    while todo:
        depth, prefix, inside = todo.pop()
        if not inside:
            continue
        size = sum(n for *_, n in inside)
        if size <= limit or len(inside) == 1:
            out.update({k: (n, depth, prefix, size, len(inside), size <= limit) for _, k, n in inside})
            continue
        for bit in (0, 1):
            todo.append((depth + 1, 2 * prefix + bit, [r for r in inside if r[0] >> (59 - depth) & 1 == bit]))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 50_000, 3_000])
def test_against_brute_force(documents, limit):
    got = {r.doc_id: (r.n_bytes, r.depth, r.prefix, r.shard_bytes, r.shard_documents, r.fits)
           for r in sharding.shard(documents, max_bytes=limit).collect()}
    assert got == brute([(r.doc_id, len(r.text.encode())) for r in documents.collect()], limit)


def test_query_against_sql(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        assert compare(sharding.op2(spark, sf), oracle_connection(sf), catalog.ORACLES["op2_sharding"]) == []


def test_a_repeated_key_is_split_too(spark):
    df = spark.range(400).selectExpr("if(id < 300, 7, id) AS doc_id", "repeat('x', 10) AS text")
    rows = sharding.shard(df, max_bytes=100).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r.n_bytes
    assert len(rows) == 400 and max(size.values()) <= 100
    assert all(r.shard_bytes == size[r.shard] and r.fits for r in rows)


def test_odd_rows(odd, nothing):
    rows = sharding.shard(odd, max_bytes=200, keep=("shard_", "source")[1:]).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.n_bytes) for r in rows} >= {(2, 0), (3, 0), (None, 19)}
    assert sorted(r.doc_id for r in rows if not r.fits) == [5, 5, 7, 8]
    assert sharding.shard(nothing).collect() == []
