import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tests.llm.conftest import SF
from voxmart.llm import simhash
from voxmart.operators import components


def brute(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """(fingerprint, doc_id or None) rows to the smallest doc_id that can be reached from each fingerprint."""
    fps = sorted({f for f, _ in prints})
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                up[top(a)] = top(b)
    least = {}
    for f, d in prints:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return {f: least.get(top(f)) for f in fps}


def test_query_against_brute_force(spark, documents):
    docs = [(r.doc_id, brute(r.text)) for r in documents.collect()]
    want = brute_classes([(f, d) for d, f in docs])
    got = simhash.op9(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", want[f]) for d, f in docs)
    assert len({r.component_id for r in got}) < len(got)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_of_crowded_keys(spark, hot):
    random.seed(5)
    fps = {random.getrandbits(64) for _ in range(30)}
    for base in list(fps)[:4]:  # crowds that share half of their bits, and chains of near ones
        fps |= {base ^ (1 << random.randrange(32)) ^ (1 << random.randrange(32)) for _ in range(40)}
        fps |= {base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in zip(range(0, 60, 7), range(1, 60, 7), range(2, 60, 7))}
    rows = [(f, None if i % 9 == 4 else i - 20) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(signed(f), d) for f, d in rows], "simhash bigint, doc_id bigint")
    got = {r.simhash: r.component_id for r in simhash.classes(df, hot).collect()}
    assert got == {signed(f): d for f, d in brute_classes(rows).items()}


def test_odd_rows(spark, odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[6].component_id == 1 and by[2].component_id == by[3].component_id == by[4].component_id == 2
    assert by[2].simhash == 0 and by[None].component_id is None
    assert simhash.near_duplicates(nothing).collect() == [] and simhash.drop_near_duplicates(nothing).collect() == []
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == \
        [(False, i) for i in (1, 2, 5, 7, 8, 9)] + [(True, None)]  # no class but its own


def test_components(spark):
    n = 300
    path = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(50)] + [(2000, 2001), (2001, 2000), (5, 5)]
    df = spark.createDataFrame(path, "a int, b int").withColumn("c", F.lit(1))
    got = {r.id: r.component for r in components.connected(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}


def test_one_row_of_each_class_stays(spark):
    """Rows are told apart by doc_id and text; a doc_id with two texts, copies without a doc_id and repeated rows included."""
    rows = [(3, "text b", 1), (5, "text a", 1), (5, "text b", 1), (None, "text a", 9), (None, "text c", 2), (None, "text c", 1),
            (7, "text d", 4), (7, "text d", 2), (8, "text d", 0), (9, None, 0), (2, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, simhash int")
    got = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(3, "text b", 1), (5, "text a", 1), (None, "text c", 1), (7, "text d", 2), (2, "", 1)], key=repr)
