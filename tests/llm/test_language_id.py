import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from voxmart.llm import language_id as lid


def brute_counts(texts):
    out = np.zeros(lid.SIZE, np.int64)
    for t in texts:
        b = bytes(lid._FOLD[x] for x in b" " + t.encode() + b" ")
        for i in range(len(b) - 2):
            if b[i: i + 3] != b"   ":
                out[((int.from_bytes(b[i: i + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - lid.BITS)] += 1
    return out


def test_held_out_accuracy(spark, documents):
    truth = {r.doc_id: (r.lang, zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in documents.collect()}
    rows = lid.op10(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == {d: h for d, (_, h) in truth.items()}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_and_margins_against_brute_force(documents):
    few = documents.orderBy("doc_id").limit(30)
    rows = few.collect()
    got = {r.lang: np.frombuffer(r.counts, np.int64) for r in lid._sum_counts(lid.trigram_counts(few, "text", "lang")).collect()}
    by = {g: [r.text for r in rows if r.lang == g] for g in {r.lang for r in rows}}
    assert set(got) == set(by) and all((got[g] == brute_counts(by[g])).all() for g in by)
    model = lid.Model(got)
    texts = [r.text.encode() for r in rows] + [b"", b"x", b"long text " * 60_000]
    margin, size = model.margins(*lid.kernels.join_texts(texts))
    for t, m, n in zip(texts, margin, size):
        hist = brute_counts([t.decode()])
        assert n == hist.sum() and np.allclose(m, hist @ model.weights / max(1, n), rtol=1e-3, atol=1e-4)


def test_codes_correct_errors():
    for n in (2, 3, 4, 7, 30):
        code = lid.codewords(n)
        assert all((np.abs(c.sum()) < n) for c in code.T)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2 if n == 3 else 4)
    model = lid.Model({g: np.bincount(np.arange(400) + 300 * i, minlength=lid.SIZE) for i, g in enumerate("abcd")})
    flipped = model.code.copy()
    flipped[:, 2] *= -1  # one wrong answer is outvoted
    assert model.decode(flipped, np.full(4, 50))[0].tolist() == [0, 1, 2, 3]


def test_odd_rows(spark, odd, nothing):
    model = lid.learn(odd)
    rows = {r.doc_id: r for r in lid.identify(odd, model).collect()}
    assert lid.identify(odd, model).count() == odd.count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].ambiguous for i in (2, 3, 4, 9))
    assert rows[5].lang_pred == "en" and rows[7].lang_pred == "de" and rows[8].lang_pred == "fr" and rows[1].bytes == "bytes"
    assert rows[1].score != "score"
    assert {r.lang_pred for r in lid.identify(odd, lid.learn(nothing)).collect()} == {"und"}
    one = lid.learn(odd.filter("lang = 'de'"))
    assert {r.lang_pred for r in lid.identify(odd, one).collect()} == {"und", "de"}
    assert lid.identify(nothing, model).collect() == []
    kept = lid.keep_identified(odd)
    assert kept.columns == odd.columns and {1, 5, 7, 8} >= {r.doc_id for r in kept.filter(F.col("doc_id") != 6).collect()}
    assert lid.keep_identified(nothing).collect() == []


def test_the_language_stage_sends_each_text_once(spark):
    docs = spark.createDataFrame([(1, "hello there", "en"), (2, "guten tag", "de")], "doc_id long, text string, lang string")
    sent = lid.keep_identified(docs)._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1]
    assert "identified" not in sent and "struct(" not in sent
