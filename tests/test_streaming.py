"""Continuous jobs over several micro-batches: late rows, state that is freed, alerts that rise and fall, replays."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from voxmart.operators import issues
from voxmart.streaming import jobs


@pytest.fixture()
def places(tmp_path):
    return tuple(str(tmp_path / n) for n in ("in", "out", "ck"))


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, jobs.ROCKSDB)
    yield
    spark.conf.set(name, held)


def feed(spark, src, batches, schema, writer):
    """Each batch lands and is a run of its own from the checkpoint; the rows in state and the dropped ones after each."""
    told = []
    for rows in batches:
        df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(src)
        q = writer(jobs.landing(spark, src, spark.read.parquet(src).schema, "*.parquet")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        states = [op for p in q.recentProgress for op in p["stateOperators"]]
        told.append((states[-1]["numRowsTotal"], sum(op["numRowsDroppedByWatermark"] for op in states)))
    return told


MENTION = "created_at timestamp, source string, sentiment string, score double"


def said(h, m=0, tone="negative", day=1):
    return (D(2026, 7, day, h, m), "x", tone, -0.5)


def test_windows_leave_once_and_their_state_is_freed(spark, places):
    src, out, ck = places
    batches = [[said(1), said(1, 30), said(2)], [said(4), said(3, 10)], [said(1, 5), said(4, 59)]]  # 01:05 comes too late
    rows = spark.createDataFrame([r for b in batches for r in b], MENTION)
    told = feed(spark, src, [*batches, jobs.closing_record(rows)], MENTION, lambda r: jobs.append_to(jobs.windowed_volume(r), out, ck))
    got = sorted((r["window_start"].hour, r["mentions"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2), (2, 1), (3, 1), (4, 2)]
    assert sum(dropped for _, dropped in told) == 1
    assert told[-1][0] == 1  # the closing record's own window


def test_closing_record_of_nothing(spark):
    assert jobs.closing_record(spark.createDataFrame([], MENTION)).collect() == []


def test_alerts_rise_and_fall(spark, places):
    src, out, ck = places
    table = jobs.AlertTable(out)
    write = lambda r: jobs.spike_alerts(jobs.windowed_volume(r), 2).writeStream.outputMode("update").foreachBatch(table) \
        .option("checkpointLocation", ck)
    state = lambda: {(r["day"].day, r["window_start"].hour): (r["status"], r["mentions"], r["batch"]) for r in table.read(spark).collect()}
    feed(spark, src, [[said(1)]], MENTION, write)
    assert table.read(spark) is None
    feed(spark, src, [[said(1, 10), said(2, day=2), said(2, 1, day=2)]], MENTION, write)
    before = state()
    assert before[1, 1][:2] == ("raised", 2) and before[2, 2][:2] == ("raised", 2)
    feed(spark, src, [[said(2, 20, "positive", 2), said(2, 21, "positive", 2), said(2, 22, "positive", 2)]], MENTION, write)
    after = state()
    assert after[2, 2][:2] == ("withdrawn", 5) and after[1, 1] == before[1, 1]
    feed(spark, src, [[said(2, 30 + i, day=2) for i in range(9)]], MENTION, write)
    assert state()[2, 2][:2] == ("raised", 14)


def test_alert_batch_replayed(spark, tmp_path):
    table = jobs.AlertTable(str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "alert_id string, window_start timestamp, mentions bigint, hot boolean")
    table(rows(("a", D(2026, 7, 1), 5, True), ("b", D(2026, 7, 2), 1, False)), 0)
    second = rows(("a", D(2026, 7, 1), 9, False), ("b", D(2026, 7, 2), 7, True))
    table(second, 1)
    once = sorted(map(tuple, table.read(spark).collect()))
    table(second, 1)
    assert sorted(map(tuple, table.read(spark).collect())) == once
    assert {r["alert_id"]: (r["status"], r["mentions"], r["batch"]) for r in table.read(spark).collect()} == \
        {"a": ("withdrawn", 9, 1), "b": ("raised", 7, 1)}


SEEN = "source_id string, captured_at timestamp, likes bigint, first_seen timestamp"


def test_retired_posts_stay_silent_and_numbers_go_on(spark, places, rocksdb):
    src, out, ck = places
    first = D(2026, 7, 1)
    stored = spark.createDataFrame([("p", 3, 40, first), ("r", 12, 1, first), ("z", None, None, None)],
                                   "source_id string, refresh_count int, likes bigint, first_seen timestamp")
    batches = [[("p", D(2026, 7, 1, h), 50 + h, first) for h in range(6)] + [("r", D(2026, 7, 1, 1), 9, first), ("z", D(2026, 7, 1, 2), 5, None)],
               [("p", D(2026, 7, 1, 8 + h), 70, first) for h in range(8)]]
    feed(spark, src, batches, SEEN, lambda r: jobs.append_to(jobs.engagement_lifecycle(r, stored=stored), out, ck))
    got = sorted((r["source_id"], r["iteration"], r["likes_delta"], r["retired"]) for r in spark.read.parquet(out).collect())
    assert got == [("p", 4, 10, False), *[("p", i, 1, False) for i in range(5, 10)], ("p", 10, 15, False), ("p", 11, 0, False), ("p", 12, 0, True), ("z", 1, None, False)]


def test_timers_end_a_life_and_it_never_starts_again(spark, places, rocksdb):
    src, out, ck = places
    first = D(2026, 7, 1)
    batches = [[("p", D(2026, 7, 1, h), h, first) for h in range(4)], [("q", D(2026, 7, 6), 1, D(2026, 7, 6))],
               [("q", D(2026, 7, 6, 1), 2, D(2026, 7, 6))], [("p", D(2026, 7, 6, 2), 99, first), ("p", D(2026, 7, 1, 5), 98, first)]]
    rows = spark.createDataFrame([r for b in batches for r in b], SEEN)
    late = jobs.LateRows()
    spark.streams.addListener(late)
    try:
        # The closing record has no post; it only moves the watermark.
        told = feed(spark, src, [*batches, jobs.closing_record(rows, "captured_at")], SEEN,
                    lambda r: jobs.append_to(jobs.engagement_lifecycle(r), out, ck))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(late)
    got = sorted((r["source_id"], r["iteration"], r["likes"]) for r in spark.read.parquet(out).collect() if r["source_id"])
    assert got == [("p", i + 1, i) for i in range(4)] + [("q", 1, 1), ("q", 2, 2)]
    assert sum(late.dropped.values()) == 1 and told[0][0] > 0


def test_scoring_keeps_a_ledger(spark, places):
    src, out, ck = places
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    schema = spark.createDataFrame([], "source_id string, model string").schema

    def scorer(records):
        if any(r["source_id"] == "p3" for r in records):
            raise ValueError("no")
        return [{"source_id": r["source_id"], "model": "deep"} for r in records]

    hook = jobs.Scorer(out, lexicon, scorer, schema, size=1)
    posts = [(f"p{i}", ["a good day", "a bad day", "a day"][i % 3]) for i in range(9)]
    run = lambda r: r.writeStream.foreachBatch(hook).option("checkpointLocation", ck)
    for part in (posts[:5], posts[5:]):
        spark.createDataFrame(part, "source_id string, text string").coalesce(1).write.mode("append").parquet(src)
        assert run(jobs.landing(spark, src, spark.read.parquet(src).schema)).trigger(availableNow=True).start().awaitTermination(120)
    ledger = [tuple(r) for r in spark.read.parquet(f"{out}/ledger").orderBy("batch").select("posts", "deep", "refused").collect()]
    assert ledger == [(5, 3, 0), (4, 3, 0)]
    hook(spark.createDataFrame([("p3", "a bad day"), ("p4", "a bad day")], "source_id string, text string").coalesce(1), 1)  # replaces batch 1
    assert tuple(spark.read.parquet(f"{out}/ledger/batch=1").first()) == (2, 1, 1)
    assert [r["error"] for r in spark.read.parquet(f"{out}/refused/batch=1").collect()] == ["ValueError: no"]
    assert spark.read.parquet(f"{out}/baseline").count() == 7


def test_reclustering_sees_what_has_arrived(spark, tmp_path):
    hook = jobs.Recluster(str(tmp_path / "r"), 4, issues.cluster, issues.assign)
    post = lambda *ids: spark.createDataFrame([(i, [1.0, 0.0] if i < "c" else [0.0, 1.0]) for i in ids], "source_id string, embedding array<double>")
    state = lambda: {r["source_id"]: (r["cluster"], r["kind"]) for r in hook.read(spark).collect()}
    hook(post("b1", "x1"), 0)
    assert hook.read(spark) is None
    hook(post("b0", "x0"), 1)
    assert state() == {"b0": ("b0", "full"), "b1": ("b0", "full"), "x0": ("x0", "full"), "x1": ("x0", "full")}
    hook(post("a9"), 2)
    assert state()["a9"] == ("b0", "assigned") and state()["x1"] == ("x0", "assigned")
    hook(post("a9"), 2)  # a replay
    assert len(state()) == 5
    hook(post("d1", "d2", "d3"), 3)
    assert state()["b1"] == ("a9", "full") and state()["d3"] == ("d1", "full")


def test_a_table_that_is_a_folder_streams(spark, tmp_path):
    from voxmart.plans import catalog_streaming as c
    rows = spark.createDataFrame([(i, "text") for i in range(9)], "doc_id bigint, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        out, ck = str(tmp_path / f"{kind}-out"), str(tmp_path / f"{kind}-ck")
        c.run(c.jobs.append_to(c.stream(spark, str(tmp_path / kind), "documents"), out, ck))
        assert spark.read.parquet(out).count() == 9
