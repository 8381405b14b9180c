"""Findings against Python's own regular expressions and plain loops."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tools.check import compare, oracle_connection
from voxmart.llm import credentials

KEYS = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"


def base(text):
    """(start, number of the kind, end), by the contract's own words."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def brute(text, reach=credentials.REACH):
    text = text or ""
    found = base(text)
    weak = [(m.start(), i, m.end()) for i, (kind, pattern, _) in enumerate(credentials.KINDS) if i >= 3 for m in re.finditer(pattern, text)
            if kind != "opaque" or all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in found)]
    ends = [m.start() for m in re.finditer(r"\n[\x20\x09\r]*\n[\x20\x09\r\n]*", text)]
    scope = lambda s: sum(e < s[0] for e in ends)
    role = lambda s: credentials.KINDS[s[1]][2] == "S"
    told = [w for w in weak if any(scope(w) == scope(p) and role(w) != role(p) and (0 <= w[0] - p[2] <= reach or 0 <= p[0] - w[2] <= reach)
                                   for p in found + weak)]
    return sorted(found + told)


def found(df, **options):
    return sorted(((r.doc_id, [(f.start, f.at, f.end) for f in r.findings]) for r in credentials.findings(df, **options).collect()), key=repr)


def want(rows, **options):
    return sorted(((d, brute(t, **options)) for d, t in rows), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    parts = ["password=", "Secret: ", "token = '", "api_key:", "APIKEY=\"", "user=", "login: ", "client_id=", "https://a.b/c?d=", "AKIA", "0a1b" * 9,
             "Ab1" * 9, "s3://x", "\n\n", "\n \t\n", "\n", " ", " and ", "🙂é", "value_12", "ABCDEFGH12345678", "abcdef", "=", ":", "\"", "x" * 90, "y " * 60]
    return ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(n)]


def test_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(made(1, 500))] + [(None, "user=bob " + "Zz9" * 8), (3, None), (3, ""), (3, "token=abcdefgh"), (3, "token=abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == want(rows)
    assert found(docs, reach=15) == want(rows, reach=15)
    told = [f for _, fs in want(rows) for f in fs]
    assert min(sum(f[1] == i for f in told) for i in range(6)) > 10
    assert sum(f[1] > 2 for f in told) < sum(len(re.findall(p, t or "")) for _, t in rows for _, p, _ in credentials.KINDS[3:])


def test_weak_parts_only_together(spark):
    key = "Zx9" * 8
    rows = [(1, key), (2, "user=bob"), (3, "https://host/x"), (4, f"user=bob {key}"), (5, f"user=bob\n\n{key}"), (6, f"https://host/x\n{key}"),
            (7, "user=bob" + " " * 200 + key), (8, "user=bob" + " " * 201 + key), (9, f"secret={key} user=bob"), (10, "user=bob https://h/x")]
    got = dict(found(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: [f[1] for f in fs] for d, fs in got.items()} == {1: [], 2: [], 3: [], 4: [3, 4], 5: [], 6: [5, 4], 7: [3, 4], 8: [], 9: [0, 3], 10: []}


def test_crowded_and_long_texts(spark):
    rows = [(1, ("user=bob " + "Zx9" * 8 + " ") * 4000), (2, "x" * 400000), (3, "token" * 50000), (4, "\n" * 100000 + "user=bob"),
            (5, "deadbeef" * 50000), (6, "AKIA" * 50000), (7, ("a" * 23 + " ") * 10000)]
    got = dict(found(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(got[1]) == 8000 and [len(got[i]) for i in range(2, 8)] == [0, 0, 0, 1, 1, 0]


def test_odd_rows(spark, odd, nothing):
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == want(rows)
    clash = odd.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("row", "assign", "scope", "text_", "at", "end", "findings")])
    assert found(clash) == want(rows)
    assert credentials.findings(nothing).collect() == []


def test_query(spark, documents, tmp_path):
    got = credentials.op12(spark, SF)
    assert compare(got, oracle_connection(SF), credentials.ORACLE) == []
    for r, (text,) in zip(sorted(got.collect(), key=lambda r: r.doc_id), documents.orderBy("doc_id").select("text").collect()):
        spelled = ",".join(f"{credentials.KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(base(text)))
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
    spark.createDataFrame(list(enumerate(made(2, 300))), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    (part,) = (tmp_path / "d").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    assert compare(credentials.op12(spark, str(tmp_path)), oracle_connection(str(tmp_path)), credentials.ORACLE) == []
