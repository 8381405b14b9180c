"""Alignment against whole-text encodings and set operations in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from voxmart.llm import alignment, tokens

A, B = tokens.public("byte_bpe_50k.json"), tokens.public("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def groups_of(text, made={}):
    """Lists of ids of A and of B between common ends, None without tokens."""
    if not made:
        made["a"], made["b"] = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        made["a"].encode_special_tokens = True
        made["letters"] = alignment.byte_letters()
    if not text:
        return None
    e = made["a"].encode(" " + text, add_special_tokens=False)
    first = [(i, bytes(made["letters"][c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    second = [(i, bytes([int(made["b"].id_to_piece(i)[1:-1], 16)]) if made["b"].is_byte(i) else
               made["b"].id_to_piece(i).replace("▁", " ").encode()) for i in made["b"].encode(text)]
    if not (b"".join(x for _, x in first) == (" " + text).encode() == b"".join(x for _, x in second)):
        return None
    ends = []
    for side in (first, second):
        at = np.cumsum([len(x) for _, x in side]).tolist()
        ends.append(dict(zip(at, range(1, len(at) + 1))))
    out, i, j = [], 0, 0
    for cut in sorted(ends[0].keys() & ends[1].keys()):
        out.append(([x for x, _ in first[i: ends[0][cut]]], [x for x, _ in second[j: ends[1][cut]]]))
        i, j = ends[0][cut], ends[1][cut]
    return out


def brute(rows):
    found = [(d, groups_of(t)) for d, t in rows]
    links = [[(x, y) for a, b in g or [] for x in a for y in b] for _, g in found]
    count = Counter(p for one in links for p in set(one))
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for (d, g), mine in zip(found, links):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(mine),
                    sum(count[p] == best[p[0]] for p in mine), sum(count[p] for p in mine),
                    hashlib.sha256(spelled.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


STRANGE = ["a▁b c", " ▁", "<|endoftext|> and </s> <s> <unk> <0x41>", "x  y   z", " lead and trail ", "\n \n a\n b \n", "tab\t tab \t x",
           "a   b 　c  d", "漢字かな交じり文 и русский 🙂🙂 é", "\x00 nul \x7f", "ab" * 3000, " " * 300, "=" * 500 + " -" * 40,
           "don't I'll we've 12345 3.14,5", "\r\n\r\n{\r } );\r", "ﬁ Ａ ① ǆ"]


def test_query_against_brute_force(spark, documents):
    want = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert result(alignment.op13(spark, SF)) == want
    assert sum(r[4] for r in want) > sum(r[3] for r in want) > 1000


def test_strange_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 20)
    random.seed(3)
    pool = [" ", "  ", "\n", "\t", " ", "the", "ing", "ñé", "漢", "▁", "12", ".", "🙂", "'s", "\r"]
    made = ["".join(random.choice(pool) for _ in range(random.randrange(25))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(STRANGE + made)] + [(None, "no id"), (7, None), (7, ""), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(alignment.align(docs, A, B)) == brute(rows)
    assert result(alignment.align(docs, A, B, hot=3)) == brute(rows)
    assert sum(r[7] == "" for r in brute(rows)) > 20


def test_no_hot_pairs(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one")], "doc_id int, text string")
    rows = alignment.cut_lineage(alignment.aligned(docs, A, B), "test")
    counts = alignment.pair_counts(rows, 50257, 32000)
    found = alignment.with_counts(rows, counts.filter("false"), 5)
    assert [(r.n_best, r.count_sum) for r in found.collect()] == [(0, 0)] * 2


def test_components_by_overlap():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = (np.array(sorted({n, *rng.choices(range(1, n + 1), k=rng.randrange(n))})) for _ in "ab")
        common = sorted(set(a.tolist()) & set(b.tolist()))
        of_a, of_b = alignment.components(a, b)
        assert of_a.tolist() == np.searchsorted(common, a).tolist() and of_b.tolist() == np.searchsorted(common, b).tolist()
    assert [x.tolist() for x in alignment.components(np.empty(0, int), np.empty(0, int))] == [[], []]


def test_odd_rows(spark, odd, nothing):
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    assert result(alignment.align(odd, A, B)) == brute(rows)
    clash = odd.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("row", "t", "pairs", "times", "n_a", "best_", "c", "pair")])
    assert result(alignment.align(clash, A, B)) == brute(rows)
    assert alignment.align(nothing, A, B).collect() == []
