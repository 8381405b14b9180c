"""Continuous jobs. Mappers and cleaning are the batch ones; what is added here is event time,
state and sinks. Every job takes a streaming DataFrame and returns a writer or a DataFrame, so
the caller chooses trigger and checkpoint."""

from __future__ import annotations

import heapq
import sys
from collections import Counter
from collections.abc import Callable
from datetime import timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQueryListener

from voxmart.config import THRESHOLDS
from voxmart.functions import pii, text
from voxmart.functions.labels import is_negative
from voxmart.operators import scoring
from voxmart.session import cut_lineage

# What runs inside tasks travels with them, whether or not the workers have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------- sources
def landing(spark: SparkSession, folder: str, schema, pattern: str = "*", fmt: str = "parquet",
            files_per_batch: int | None = None) -> DataFrame:
    """Files as they land in a folder."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def topic(spark: SparkSession, servers: str, name: str) -> DataFrame:
    """A Kafka topic as (payload) rows; needs the Kafka connector on the cluster."""
    rows = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", name).load())
    return rows.select(F.col("value").cast("string").alias("payload"))


# ---------------------------------------------------------------- ingest
def deduplicated(posts: DataFrame, delay: str = "1 day", event_time: str = "created_at", key: str = "source_id") -> DataFrame:
    """One row per id; an id seen again within the delay is ignored and its state then dropped."""
    return posts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def append_to(posts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (posts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append"))


def enriched(posts: DataFrame) -> DataFrame:
    """Stateless cleaning of a stream: text, hash, language, spam, masked text."""
    base = posts.withColumns({"n_urls": text.url_count(F.col("text")), "clean": text.clean_text(F.col("text"))})
    out = pii.mask_pii(base, "clean", masked="clean_text")
    return out.select("source_id", "clean_text", text.dedup_key(F.col("clean")).alias("text_hash"),
                      text.detect_language(F.col("clean")).alias("lang"), text.spam_flag(F.col("clean"), F.col("n_urls")).alias("spam_flag"),
                      F.array_join("pii_type_list", ",").alias("pii_types"))


def split_undated(posts: DataFrame, dated_path: str, undated_path: str, checkpoint: str,
                  event_time: str = "created_at") -> DataStreamWriter:
    """Rows without an event time cannot be windowed: they go to a side table instead of being lost.

    Batches are written under their number, so a replayed batch overwrites itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.filter(F.col(event_time).isNotNull()).write.mode("overwrite").parquet(f"{dated_path}/batch={number}")
        batch.filter(F.col(event_time).isNull()).write.mode("overwrite").parquet(f"{undated_path}/batch={number}")

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class LateRows(StreamingQueryListener):
    """Adds up the rows that watermarks have dropped, over the whole life of each query.

    Register it with ``spark.streams.addListener`` before the queries start; a query's own progress list keeps the last hundred
    reports only.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.dropped[str(event.progress.id)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


# ---------------------------------------------------------------- windows
def windowed_volume(posts: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "1 hour",
                    by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Mentions, negatives and mean score per tumbling or sliding window."""
    span = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return posts.withWatermark("created_at", delay).groupBy(span.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("mentions"), F.count_if(is_negative(F.col("sentiment"))).alias("negatives"),
        F.avg("score").alias("avg_score")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                                                  "mentions", "negatives", "avg_score")


def conversation_sessions(posts: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Bursts of one conversation: a session ends after ``gap`` without a post."""
    return posts.withWatermark("created_at", delay).groupBy(F.session_window("created_at", gap).alias("w"), "conversation_id").agg(
        F.count(F.lit(1)).alias("posts"), F.avg("score").alias("avg_score")).select(
        "conversation_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "posts", "avg_score")


def closing_record(rows: DataFrame, event_time: str = "created_at", after: str = "36500 days") -> DataFrame:
    """One row that ends a bounded run: nothing but an event time far behind all of ``rows``. Once it has landed, the watermark
    passes every open window and their state is freed; its own window never closes, so it is never emitted."""
    last = rows.agg(F.max(event_time).alias(event_time)).filter(F.col(event_time).isNotNull())
    return last.select(*[(F.col(event_time) + F.expr(f"interval {after}")).cast(f.dataType).alias(f.name) if f.name == event_time
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


# ---------------------------------------------------------------- alerts
def spike_alerts(windows: DataFrame, min_mentions: int, min_share: float = THRESHOLDS.emerging_share) -> DataFrame:
    """Windows as alert rows keyed by what they are about; ``hot`` tells whether they are large and mostly negative."""
    share = F.col("negatives") / F.col("mentions")
    subject = F.concat_ws("|", F.lit("spike"), "source", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm"))
    return windows.select(F.concat(F.lit("alert:"), F.substring(F.md5(subject), 1, 16)).alias("alert_id"), F.lit("spike").alias("kind"),
                          F.lit("high").alias("severity"), F.col("source").alias("subject"), "window_start", "mentions", "negatives",
                          ((F.col("mentions") >= min_mentions) & (share >= min_share)).alias("hot"))


class AlertTable:
    """``foreachBatch`` hook that keeps a table of alerts, partitioned by the day of their window, true to the newest numbers.

    A window that has become hot raises its alert, one that is no longer hot withdraws it. Only the days that a batch touches
    are read and rewritten. A row depends on its key's stored row and the batch alone, and withdrawn alerts stay as such rows,
    so a batch that is replayed, after it has been written in part too, leaves the same table.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut_lineage(batch.withColumn("day", F.to_date("window_start")), "alerts")
        days = [r["day"] for r in new.select("day").distinct().collect()]  # of one batch, at most as many as the watermark spans
        values = [c for c in batch.columns if c not in ("alert_id", "hot")]
        old = self.read(spark)
        if old is None:
            old = spark.createDataFrame([], new.drop("hot").schema.add("status", "string").add("batch", "long"))
        kept = old.filter(F.col("day").isin(*days)).select("day", "alert_id", F.struct(*values, "status", "batch").alias("o"))
        own = new.select("day", "alert_id", F.struct(*values, F.when(F.col("hot"), "raised").otherwise("withdrawn").alias("status"),
                                                     F.lit(number).cast("long").alias("batch")).alias("n"))
        merged = kept.join(own, ["day", "alert_id"], "full").filter((F.col("n.status") == "raised") | F.col("o").isNotNull())
        out = cut_lineage(merged.select("alert_id", F.coalesce("n", "o").alias("r"), "day").select("alert_id", "r.*", "day"), "alerts")
        if days:
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table, None before the first alert. Its columns are read as they were written."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root) or not any("day=" in f.getPath().getName() for f in fs.listStatus(root)):
            return None
        return spark.read.parquet(self.path).withColumn("day", F.col("day").cast("date"))


# ---------------------------------------------------------------- engagement lifecycle
HISTORY = ("source_id string, iteration int, captured_at timestamp, likes bigint, likes_delta bigint, retired boolean")
STATE = "done int, likes bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Passes(StatefulProcessor):
    """Numbers the snapshots of a post; see ``engagement_lifecycle``."""

    def __init__(self, passes: int, idle_ms: int):
        self.passes, self.idle_ms = passes, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("passes", STATE)

    def _ends(self, first_seen) -> None:
        """The post's life ends ``idle_ms`` after it was first seen. Timers are in UTC, as is the session."""
        if first_seen is not None:
            self.handle.registerTimer(int(first_seen.replace(tzinfo=timezone.utc).timestamp() * 1000) + self.idle_ms + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.state.update((initialState["refresh_count"] or 0, initialState["likes"]))
        self._ends(initialState["first_seen"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        done, last = (known[0], known[1]) if known else (0, None)
        room = max(self.passes - done, 0)
        first, out = None, []

        def dated(rows):
            nonlocal first
            for r in rows:
                if r["first_seen"] is not None and (first is None or r["first_seen"] < first):
                    first = r["first_seen"]
                yield r

        # Of a batch only the earliest snapshots that still count are held.
        for r in heapq.nsmallest(room, dated(rows), key=lambda r: (r["captured_at"], r["likes"])):
            done += 1
            out.append(Row(source_id=key[0], iteration=done, captured_at=r["captured_at"], likes=r["likes"],
                           likes_delta=None if last is None else r["likes"] - last, retired=done >= self.passes))
            last = r["likes"]
        if out:
            self.state.update((done, last))
            self._ends(first)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def engagement_lifecycle(snapshots: DataFrame, passes: int = THRESHOLDS.refresh_max_iterations, idle_ms: int = 24 * 3600 * 1000,
                         delay: str = "1 day", stored: DataFrame | None = None) -> DataFrame:
    """Numbered passes per post with the change since the last one; after ``passes`` a post retires.

    Needs (source_id, captured_at, likes, first_seen). ``stored`` (source_id, refresh_count, likes, first_seen) are the posts as
    the tables have them when the job first starts: their count goes on from there. State per post is two numbers. Snapshots
    later than ``idle_ms`` after first_seen do not count, and a timer drops the state when the watermark has passed that
    time, so the count never starts again. A post whose first_seen is null keeps its state. The state store has to be
    ``ROCKSDB``.
    """
    rows = snapshots.select("source_id", "captured_at", "likes", "first_seen").withWatermark("captured_at", delay)
    rows = rows.filter(F.col("first_seen").isNull() | (F.unix_millis("captured_at") <= F.unix_millis("first_seen") + idle_ms))
    seeds = None if stored is None else stored.select("source_id", "refresh_count", "likes", "first_seen").groupBy("source_id")
    return rows.groupBy("source_id").transformWithState(Passes(passes, idle_ms), HISTORY, "append", "EventTime", seeds)


# ---------------------------------------------------------------- scoring
class Scorer:
    """``foreachBatch`` hook that scores posts as they arrive: a baseline row each, and depth for those that need it.

    ``path``/baseline and ``path``/depth hold the rows, ``path``/refused the ids and errors of what an external scorer refused
    (those posts keep their baseline), and ``path``/ledger one row of counts per batch. All are written under the number of
    the batch, the ledger last: a replayed batch replaces itself, and a batch in the ledger is complete.
    """

    def __init__(self, path: str, lexicon: DataFrame, scorer: Callable[[list[dict]], list[dict]] | None = None, schema: T.StructType | None = None,
                 size: int = 12):
        self.path, self.lexicon, self.scorer, self.schema, self.size = path, lexicon, scorer, schema, size

    def _put(self, rows: DataFrame, part: str, number: int) -> DataFrame:
        place = f"{self.path}/{part}/batch={number}"
        rows.write.mode("overwrite").parquet(place)
        return rows.sparkSession.read.schema(rows.schema).parquet(place)

    def __call__(self, batch: DataFrame, number: int) -> None:
        posts = cut_lineage(batch, "scored")
        base = self._put(scoring.baseline_rows(posts, scoring.lexicon_scores(posts, self.lexicon)).drop("aspects"), "baseline", number)
        counts = base.agg(F.count(F.lit(1)).alias("posts"))
        if self.scorer is not None:
            asked = scoring.needs_depth(base).select("source_id", F.col("text_masked").alias("text"))
            tried = self._put(scoring.score_or_refuse(asked, self.scorer, self.schema, self.size), "tried", number)
            deep = self._put(tried.filter("error IS NULL").drop("error"), "depth", number)
            bad = self._put(tried.filter("error IS NOT NULL").select("source_id", "error"), "refused", number)
            counts = counts.crossJoin(deep.agg(F.count(F.lit(1)).alias("deep"))).crossJoin(bad.agg(F.count(F.lit(1)).alias("refused")))  # one row each
        self._put(counts, "ledger", number)


# ---------------------------------------------------------------- re-clustering
class Recluster:
    """``foreachBatch`` hook that stores enriched rows and clusters what is stored anew each time another ``every`` rows are there.

    Between full runs new rows go to the standing cluster of their nearest stored one, by ``assign``. Rows are kept per batch
    number below ``path``, so restarts and replays count once, and a run at batch n sees the batches up to n, whatever has been
    stored since.

    cluster: all stored rows -> (source_id, cluster). assign: new rows, stored rows with their ``cluster`` -> the same for the new.
    """

    def __init__(self, path: str, every: int, cluster: Callable[[DataFrame], DataFrame], assign: Callable[[DataFrame, DataFrame], DataFrame]):
        self.path, self.every, self.cluster, self.assign = path, every, cluster, assign

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        stored = spark.read.schema(batch.schema.add("batch", "long")).parquet(f"{self.path}/rows").filter(F.col("batch") <= number)
        seen = stored.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("batch") < number).alias("before")).first()
        if seen["all"] // self.every > seen["before"] // self.every:
            out = self.cluster(stored.drop("batch")).withColumn("kind", F.lit("full"))
        else:
            standing = self.read(spark, number - 1)
            fresh = stored.filter(F.col("batch") == number).drop("batch")
            if standing is None:
                return
            known = stored.filter(F.col("batch") < number).drop("batch").join(standing.select("source_id", "cluster"), "source_id")
            out = standing.select("source_id", "cluster").unionByName(self.assign(fresh, known).select("source_id", "cluster")) \
                .withColumn("kind", F.lit("assigned"))
        out.write.mode("overwrite").parquet(f"{self.path}/clusters/version={number}")

    def read(self, spark: SparkSession, number: int | None = None) -> DataFrame | None:
        """The newest clusters, or those of batch ``number`` or the last one before it that made any; None without any."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/clusters")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        made = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
        made = [n for n in made if number is None or n <= number]
        return spark.read.parquet(f"{self.path}/clusters/version={max(made)}") if made else None
