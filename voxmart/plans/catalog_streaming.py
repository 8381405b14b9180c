"""Streaming jobs run to completion over the tables; the oracle is the batch answer."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmart import adapters as A
from voxmart.adapters import with_ctes
from voxmart.operators import issues
from voxmart.plans.catalog_facts import NEG
from voxmart.plans.catalog_sources import firehose
from voxmart.plans.catalog_text import BASE, CLEAN, DUP, FLAGS, LEX, SCORES, lexicon
from voxmart.plans.registry import query
from voxmart.session import scratch_path
from voxmart.sources import mappers
from voxmart.streaming import jobs

M = with_ctes("mentions")


def stream(spark, sf, table):
    """A table as a stream, be it one file or a folder of files: a pattern in the path makes both files that have landed."""
    return jobs.landing(spark, f"{sf}/{table}[.]parquet", A.table(spark, sf, table).schema)


def mention_stream(spark, sf):
    return A._adapt(stream(spark, sf, "events"), A.MENTIONS)


def run(writer) -> None:
    """Everything that is there now, then stop."""
    handle = writer.trigger(availableNow=True).start()
    try:
        handle.awaitTermination()
    finally:
        handle.stop()


def run_in_slices(spark, rows, start, by="created_at", slices=3, close=True) -> None:
    """Rows land in a folder slice by slice, in order of their event time; every slice is a run of the job from its checkpoint. Then
    the closing record lands."""
    folder = scratch_path(spark, "landing")
    lo, hi = rows.agg(F.min(by).cast("double"), F.max(by).cast("double")).first()
    at = F.floor((F.col(by).cast("double") - lo) / (hi - lo + 1) * slices)
    for part in [*(rows.filter(at == i) for i in range(slices)), *([jobs.closing_record(rows, by)] if close else [])]:
        part.write.mode("append").parquet(folder)
        run(start(jobs.landing(spark, folder, rows.schema)))


@contextmanager
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, jobs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def paths(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@query("stream_ingest", """SELECT 'bsky:did' || user_id || '/' || event_id AS source_id, 'AcmeBank ' || event_type AS text FROM events
 WHERE event_id % 4 > 0 AND event_id % 5 > 0""")
def _(spark, sf):
    rows = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = firehose(spark, rows.unionByName(rows.filter("event_id % 3 = 0")))
    out, ck = paths(spark, "ingest")
    run(jobs.append_to(jobs.deduplicated(mappers.bluesky_events(twice)), out, ck))
    return spark.read.parquet(out).select("source_id", "text")


@query("stream_enrich", with_ctes("posts") + f", {CLEAN}, {DUP}, {FLAGS} SELECT source_id, text_hash, det AS lang, spam AS spam_flag FROM cf")
def _(spark, sf):
    posts = A._adapt(stream(spark, sf, "documents"), A.POSTS)
    out, ck = paths(spark, "enrich")
    run(jobs.append_to(jobs.enriched(posts), out, ck))
    return spark.read.parquet(out).select("source_id", "text_hash", "lang", "spam_flag")


@query("stream_windows", M + f"""SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M') AS window_start, source, count(*) AS mentions,
 count(*) FILTER ({NEG}) AS negatives, avg(score) AS avg_score FROM mentions GROUP BY 1, 2""")
def _(spark, sf):
    out, ck = paths(spark, "windows")
    run_in_slices(spark, A.mentions(spark, sf), lambda rows: jobs.append_to(jobs.windowed_volume(rows), out, ck))
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "source", "mentions", "negatives", "avg_score")


@query("stream_sliding_windows", M + """, s AS (SELECT score, sentiment, date_trunc('hour', created_at) - INTERVAL (i) HOUR AS w FROM mentions, (SELECT unnest(range(24)) AS i))
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS mentions FROM s GROUP BY 1""")
def _(spark, sf):
    out, ck = paths(spark, "sliding")
    run_in_slices(spark, A.mentions(spark, sf), lambda rows: jobs.append_to(jobs.windowed_volume(rows, "1 day", "1 hour", by=()), out, ck))
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "mentions")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh,
  event_id FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
SELECT 'u' || user_id AS conversation_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS posts FROM g GROUP BY user_id, s""")
def _(spark, sf):
    rows = A.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("conversation_id"),
                                               F.col("ts").cast("timestamp").alias("created_at"), F.lit(0.0).alias("score"))
    out, ck = paths(spark, "sessions")
    run_in_slices(spark, rows, lambda rows: jobs.append_to(jobs.conversation_sessions(rows), out, ck))
    return spark.read.parquet(out).select("conversation_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "posts")


@query("stream_alerts", M + f""", w AS (SELECT date_trunc('hour', created_at) AS h, source, count(*) AS mentions, count(*) FILTER ({NEG}) AS negatives
 FROM mentions GROUP BY 1, 2)
SELECT 'alert:' || substr(md5('spike|' || source || '|' || strftime(h, '%Y-%m-%dT%H:%M')), 1, 16) AS alert_id, source AS subject, mentions, negatives
 FROM w WHERE mentions >= 3 AND negatives / mentions >= 0.6""")
def _(spark, sf):
    out, ck = paths(spark, "alerts")
    table = jobs.AlertTable(out)
    run_in_slices(spark, A.mentions(spark, sf), lambda rows: jobs.spike_alerts(jobs.windowed_volume(rows).filter("source IS NOT NULL"), 3)
                  .writeStream.outputMode("update").foreachBatch(table).option("checkpointLocation", ck), close=False)
    found = table.read(spark)
    if found is None:
        return spark.createDataFrame([], "alert_id string, subject string, mentions bigint, negatives bigint")
    return found.filter("status = 'raised'").select("alert_id", "subject", "mentions", "negatives")


@query("stream_engagement", """WITH f AS (SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id),
 e AS (SELECT 'u' || user_id AS source_id, CAST(floor(value * 10) AS BIGINT) AS likes, CAST(CASE WHEN user_id % 3 = 0 THEN user_id % 12 ELSE 0 END
 + row_number() OVER (PARTITION BY user_id ORDER BY ts, floor(value * 10)) AS INT) AS iteration, CASE WHEN user_id % 3 = 0 THEN user_id % 5 END AS start
 FROM events JOIN f USING (user_id) WHERE ts <= first_seen + INTERVAL 5 DAY)
SELECT source_id, iteration, likes, likes - lag(likes, 1, start) OVER (PARTITION BY source_id ORDER BY iteration) AS likes_delta, iteration = 12 AS retired
FROM e WHERE iteration <= 12""")
def _(spark, sf):
    """A third of the posts have been refreshed before; all live for five days."""
    e = A.table(spark, sf, "events").select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"),
                                            F.col("ts").cast("timestamp").alias("captured_at"), F.floor(F.col("value") * 10).alias("likes"))
    first = e.groupBy("user_id", "source_id").agg(F.min("captured_at").alias("first_seen"))
    rows = e.join(first.drop("source_id"), "user_id").drop("user_id")
    stored = first.filter("user_id % 3 = 0").select("source_id", (F.col("user_id") % 12).cast("int").alias("refresh_count"),
                                                    (F.col("user_id") % 5).cast("long").alias("likes"), "first_seen")
    out, ck = paths(spark, "engagement")
    with rocksdb(spark):
        run_in_slices(spark, rows, lambda rows: jobs.append_to(jobs.engagement_lifecycle(
            rows, idle_ms=5 * 24 * 3600 * 1000, stored=stored), out, ck), by="captured_at", close=False)
    return spark.read.parquet(out).select("source_id", "iteration", "likes", "likes_delta", "retired")


@query("stream_undated", """SELECT CASE WHEN event_id % 10 = 0 THEN 'undated' ELSE 'dated' END AS part, count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    rows = mention_stream(spark, sf)
    undated = F.expr("CAST(substring(source_id, 4) AS BIGINT) % 10 = 0")
    out, ck = paths(spark, "undated")
    run(jobs.split_undated(rows.withColumn("created_at", F.when(~undated, F.col("created_at"))), f"{out}/dated", f"{out}/undated", ck))
    tally = lambda part: spark.read.parquet(f"{out}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return tally("dated").unionByName(tally("undated"))


@query("stream_scored", with_ctes("posts") + f""", {LEX}, {SCORES}, {BASE} SELECT source_id, sentiment, emotion, urgency, fraud_signal,
 CASE WHEN sentiment = 'positive' THEN 'baseline' WHEN CAST(substr(source_id, 5) AS BIGINT) % 7 = 0 THEN 'refused' ELSE 'deep' END AS depth FROM br""")
def _(spark, sf):
    """Posts are scored as they arrive, in several batches; the deeper scorer refuses every seventh post."""
    out, ck = paths(spark, "scored")
    schema = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("model", T.StringType())])
    hook = jobs.Scorer(out, lexicon(spark, sf), _deep, schema)
    run_in_slices(spark, A.posts(spark, sf), lambda rows: rows.writeStream.foreachBatch(hook).option("checkpointLocation", ck), close=False)
    of = lambda part: spark.read.parquet(f"{out}/{part}").select("source_id", F.lit(part).alias("part"))
    told = of("depth").unionByName(of("refused"))
    depth = F.when(F.col("part") == "depth", "deep").otherwise(F.coalesce("part", F.lit("baseline")))
    return spark.read.parquet(f"{out}/baseline").join(told, "source_id", "left").select(
        "source_id", "sentiment", "emotion", "urgency", "fraud_signal", depth.alias("depth"))


def _deep(records):
    """Stands for an external scorer: reads the masked text, leaves out what it does not want to judge."""
    return [{"source_id": r["source_id"], "model": "deep"} for r in records if int(r["source_id"].split(":")[1]) % 7]


@query("stream_recluster", """WITH b AS (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events),
 e AS (SELECT 'ev:' || event_id AS source_id, event_type, floor((epoch(ts) - lo) / (hi - lo + 1) * 3) AS slice FROM events, b),
 l AS (SELECT event_type, min(source_id) AS cluster FROM e WHERE slice < 2 GROUP BY event_type)
SELECT source_id, coalesce(cluster, source_id) AS cluster, 'assigned' AS kind FROM e LEFT JOIN l USING (event_type)""")
def _(spark, sf):
    """Posts stream in and are stored with the vector of their kind. With the second slice three fifths of them are there, and the stored
    ones are clustered; the third slice joins the standing clusters of its nearest posts."""
    out, ck = paths(spark, "recluster")
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = A.table(spark, sf, "events").select(F.concat(F.lit("ev:"), "event_id").alias("source_id"), F.col("ts").cast("timestamp").alias("created_at"), F.array(
        *[(F.col("event_type") == k).cast("double") for k in kinds], F.lit(0.05)).alias("embedding"))
    hook = jobs.Recluster(out, rows.count() * 3 // 5, issues.cluster, issues.assign)
    run_in_slices(spark, rows, lambda r: r.select("source_id", "embedding").writeStream.foreachBatch(hook).option("checkpointLocation", ck), close=False)
    return hook.read(spark)
