"""Phrases against a count of all n-grams in plain Python, with scores in exact fractions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxmart.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, support=10, inside=50):
    """The rows of ``collocations`` for (text, lang) pairs."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3):
                f[lang].update(tuple(words[i: i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, found in f.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i: i + len(p)] == p for i in range(len(q)))
                   for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]])
                                        for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


def made(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 5 else f"ä{i}é" for i in range(vocabulary)]
    ends = ["", " ", "  ", "\t", ".", " , ", "!\n", ": ", "\r\n", " ", "\x85"]
    return [("".join(rng.choice(words) + rng.choice(ends + [" "] * 30) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und", ""]))
            for _ in range(n)]


def test_brute_force(spark):
    rows = made(1, 500, 12) + [(None, "en"), ("", None), (" .,\n", "fr"), ("a a a a a a a a a a a a a a", "en")]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) > 60
    assert got(spark, rows, top=7, support=3) == brute(rows, top=7, support=3)


def test_phrases_of_one_shard_and_spread_ones_are_found(spark):
    """Ten occurrences in a single text, ten in ten texts, nine in nine."""
    rows = [("x y z. " * 10, "en")] + [(f"u v w{i}", "en") for i in range(10)] + [(f"q{i} r s", "en") for i in range(9)]
    assert [r[2] for r in got(spark, rows)] == [r[2] for r in brute(rows)] == ["u v", "x y z"]


def test_hot_copies_ties_and_long_texts(spark):
    rows = [("New York is. New York is", "en")] * 300 + made(2, 40, 40) + [("lang wort " * 60000, "de"), ("x" * 300000, "de")]
    assert got(spark, rows) == brute(rows)


def test_blocks_and_flushes_do_not_count(spark, monkeypatch):
    rows = made(3, 120, 9)
    monkeypatch.setattr(phrases, "BUFFER", 50)
    monkeypatch.setattr(phrases, "BYTES", 300)
    monkeypatch.setattr(phrases, "HOT", 2)
    assert got(spark, rows) == brute(rows)


def test_full_table_prunes_nothing_wrong(spark, monkeypatch):
    rows = made(4, 120, 9)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    assert got(spark, rows) == brute(rows)


def test_products_beyond_64_bits(spark):
    big = 10 ** 12
    found = spark.createDataFrame([("en", 1, "a", 3 * big), ("en", 1, "b", 5 * big), ("en", 2, "a b", 2 * big + 1)],
                                  "lang string, w int, phrase string, f long")
    assert phrases.scored(found).first().score == 1000000 * (2 * big + 1) ** 2 // (15 * big * big)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one two", "en")]])
def test_nothing_to_find(spark, rows):
    assert got(spark, rows) == []


def test_clashing_columns(spark):
    rows = made(5, 60, 6)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA)
    for name in ("t", "shard", "key", "phrase", "f", "h", "count", "rank"):
        docs = docs.withColumn(name, F.lit(1))
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute(rows)
    assert phrases.collocations(docs.withColumnsRenamed({"text": "body", "lang": "w"}), text="body", lang="w").count() == len(brute(rows))
