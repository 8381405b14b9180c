"""The stages one by one against brute force on what the stage before kept, and the whole against the stages."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import test_decontamination, test_packing, test_simhash
from tests.llm.conftest import SF
from tests.llm.test_language_id import brute_counts
from voxmart.llm import language_id, quality

def held(r, n, k):
    return zlib.crc32(str(r.doc_id).encode()) % n == k


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_every_stage(spark, stages):
    whole, told, good, apart, clean, packed = stages
    for before, after in zip(stages[:4], stages[1:5]):
        assert {tuple(r) for r in after} <= {tuple(r) for r in before} and list(after[0].asDict()) == COLUMNS
        assert len(after) > 0.8 * len(before) * (1 if after is not apart else 0.9)
    counts = {g: brute_counts([r.text for r in whole if r.lang == g and not held(r, 5, 0)])
              for g in {r.lang for r in whole if not held(r, 5, 0)}}
    model = language_id.Model(counts)
    texts = [r.text.encode() for r in whole]
    *_, lead = model.decode(*model.margins(*language_id.kernels.join_texts(texts)))
    sure = [r for r, x in zip(whole, lead) if x >= language_id.MARGIN and any(map(str.isalpha, r.text))]
    assert {r.doc_id for r in told} == {r.doc_id for r in sure}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = quality.learn(spark.createDataFrame(told), labels.filter(~quality.held_out()))
    scores = net.scores([np.frombuffer(r.text.encode(), np.uint8) for r in told])
    assert {r.doc_id for r in good} == {r.doc_id for r, s in zip(told, scores) if s >= quality.KEEP}
    prints = [(test_simhash.brute(r.text), r.doc_id) for r in good]
    names = test_simhash.brute_classes(prints)
    assert {r.doc_id for r in apart} == set(names.values())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in test_decontamination.brute([(r.doc_id, r.text) for r in apart], bench)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in apart} - bad
    test_packing.check(packed, [(r.doc_id, r.text) for r in clean])


def test_whole(spark, stages):
    rows = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, rows)) == sorted(tuple(r)[:5] for r in stages[-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, odd, nothing):
    for docs in (odd.select(*COLUMNS), odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "pack":
                assert out.columns == docs.columns
                assert len(rows) <= docs.count()
