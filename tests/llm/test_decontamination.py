import random
from collections import Counter

import pytest

from tests.llm.conftest import SF
from voxmart.llm import decontamination as dc


def words(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [x for x in t.split(" ") if x]


def brute_tiles(doc, item, least):
    """Greedy string tiling word by word: in each round the longest matches of unmarked words, in order of place."""
    d, t, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        most, found = least, []
        for p in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while p + n < len(doc) and j + n < len(item) and doc[p + n] == item[j + n] and not d[p + n] and not t[j + n]:
                    n += 1
                if n > most:
                    most, found = n, [(p, j)]
                elif n == most:
                    found.append((p, j))
        if not found:
            return tiles
        for p, j in found:
            if not any(d[p: p + most]) and not any(t[j: j + most]):
                tiles.append((p, j, most))
                d[p: p + most] = [True] * most
                t[j: j + most] = [True] * most


def brute(docs, bench, least=dc.MATCH, cover=dc.COVER):
    out = Counter()
    for name, text in set(docs):
        own = words(text)
        for item, bt in bench:
            b = words(bt)
            if b and set(zip(*[own[i:] for i in range(min(least, len(b)))])) & set(zip(*[b[i:] for i in range(min(least, len(b)))])):
                found = brute_tiles(own, b, min(least, len(b)))
                covered = sum(n for _, _, n in found)
                if covered >= cover * len(b):
                    out[name, item, len(b), covered, len(found), max(n for *_, n in found)] += 1
    return out


def rows(df):
    return Counter((r.doc_id, r.item_id, r.words, r.covered, r.tiles, r.longest) for r in df.collect())


def test_query_against_brute_force(spark, documents):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(dc.op5(spark, SF))
    assert got == brute([(r.doc_id, r.text) for r in documents.collect()], bench) and got


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for trial in range(300):
        letters = "ab" if trial % 2 else "abcdefg"
        item = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        doc = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        if trial % 3 == 0:
            cut = rng.randrange(len(item))
            doc = doc[:5] + item[cut:] + doc[5:9] + item[:cut]
        width = min(3, len(item))
        seeds = [hash(tuple(item[i: i + width])) for i in range(len(item) - width + 1)]
        hits = [(i, hash(tuple(doc[i: i + width]))) for i in range(len(doc) - width + 1)]
        got = dc.tile([h for h in hits if h[1] in seeds], seeds, len(item), width)
        assert got == brute_tiles(doc, item, width)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, " ".join(make(30))) for i in range(20)] + [(100, "Only Three words"), (101, ""), (102, None), (None, " ".join(make(12)))]
    items.append((103, items[0][1].upper()))
    docs = []
    for i, (_, t) in enumerate(items[:12]):
        w = t.split()
        parts = [w[0:10], w[10:20], w[20:30]]
        rng.shuffle(parts)
        docs.append((i, " ".join(make(50) + parts[0] + make(3) + parts[1] + make(7) + parts[2])))
    docs += [(50, " ".join(items[3][1].split()[:12])), (51, "x only\nTHREE words y"), (52, items[-2][1]), (None, items[5][1]), (0, docs[0][1])]
    return items, docs


def test_reordered_passages(spark, planted):
    items, docs = planted
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = rows(dc.contaminated(df, bench))
    assert got == brute(docs, items)
    assert {(i, i) for i in range(12)} | {(0, 103), (51, 100), (52, None), (None, 5)} == {(d, i) for d, i, *_ in got}
    assert sorted((r.doc_id for r in dc.drop_contaminated(df, bench).collect())) == [50]


def test_odd_rows(spark, odd, nothing, planted):
    bench = spark.createDataFrame([*planted[0], (7, "one two three four five six.")], "item_id bigint, text string")
    got = dc.contaminated(odd, bench).collect()
    assert sorted(r.doc_id for r in got) == [1, 6] and {r.item_id for r in got} == {7}
    assert dc.contaminated(odd, bench.limit(0)).collect() == [] == dc.contaminated(nothing, bench).collect()
    kept = dc.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert dc.drop_contaminated(nothing, bench).collect() == []
