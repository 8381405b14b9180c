"""Who is next: reply drafts, translations, engagement refresh, alerts, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmart.config import (BRAND, FOLLOW_UP_INTENTS, NEGATIVE_TONES, REFRESHABLE_SOURCES, THRESHOLDS, Brand)
from voxmart.functions import labels


# ---------------------------------------------------------------- replies, translations
def reply_worklist(rows: DataFrame, drafted: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Undrafted complaints, most urgent and most negative first; with ``limit`` the first ones."""
    todo = rows.filter(F.col("sentiment").isin(*NEGATIVE_TONES) & F.col("intent").isin(*FOLLOW_UP_INTENTS))
    if drafted is not None:
        todo = todo.join(drafted.select("source_id"), "source_id", "left_anti")
    todo = todo.orderBy(F.desc(labels.urgency_rank(F.col("urgency"))), F.asc_nulls_first("score"), "source_id")
    return todo if limit is None else todo.limit(limit)


def template_drafts(worklist: DataFrame, template: str, brand: Brand = BRAND) -> DataFrame:
    """One draft per row from the house template, in which ``{brand}`` stands for the brand's name."""
    return worklist.select("source_id", F.lit(template.format(brand=brand.name)).alias("draft"),
                           F.lit("template").alias("model"))


def drafts_view(drafts: DataFrame, rows: DataFrame) -> DataFrame:
    detail = rows.select("source_id", "urgency", "author", F.col("text_masked").alias("complaint"), "url")
    return drafts.join(detail, "source_id").select("source_id", "urgency", "author", "complaint", "draft", "model",
                                                   "url")


def translation_worklist(clean: DataFrame, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    todo = clean.filter(F.col("lang").isin("hi", "hi-en") & (F.col("clean_text") != ""))
    if done is not None:
        todo = todo.join(done.select("source_id"), "source_id", "left_anti")
    return todo if limit is None else todo.orderBy("source_id").limit(limit)


def passthrough_translations(worklist: DataFrame) -> DataFrame:
    return worklist.select("source_id", "lang", F.col("clean_text").alias("english"),
                           F.lit("passthrough").alias("model"))


def language_view(clean: DataFrame, posts: DataFrame, translations: DataFrame) -> DataFrame:
    """Every cleaned post with its author, its translation and the language that counts."""
    p = posts.select("source_id", "author", F.col("lang").alias("_raw_lang"), "url", "created_at")
    t = translations.select("source_id", "english")
    return (clean.join(p, "source_id").join(t, "source_id", "left")
            .withColumn("effective_lang", F.coalesce("lang", "_raw_lang", F.lit("en"))).drop("_raw_lang"))


# ---------------------------------------------------------------- engagement refresh
def refresh_due(posts: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Posts young enough, under the pass cap, and rested for one interval; with ``limit`` those of the fewest passes, rested
    longest."""
    t = THRESHOLDS
    seconds = lambda a, b: F.unix_timestamp(a) - F.unix_timestamp(b)
    age_ok = F.col("fetched_at").isNull() | (
        seconds(as_of, F.col("fetched_at")) <= t.refresh_max_iterations * t.refresh_interval_hours * 3600)
    rested = F.col("last_refreshed_at").isNull() | (
        seconds(as_of, F.col("last_refreshed_at")) >= t.refresh_interval_hours * 3600)
    due = posts.filter((F.coalesce("refresh_count", F.lit(0)) < t.refresh_max_iterations) & age_ok & rested
                       & F.col("source").isin(*REFRESHABLE_SOURCES))
    order = (F.coalesce("refresh_count", F.lit(0)), F.asc_nulls_first("last_refreshed_at"), "source_id")
    return due if limit is None else due.orderBy(*order).limit(limit)


def apply_refresh(due: DataFrame, metrics: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(patched posts, history rows). The pass counter rises even when nothing came back;
    history is kept only where at least one metric was measured."""
    m = metrics.select("source_id", "likes", "reshares", "comments", "views")
    hit = due.join(m, "source_id", "left").withColumn(
        "iteration", (F.coalesce("refresh_count", F.lit(0)) + 1).cast("int"))
    patched = hit.withColumns({
        "refresh_count": F.col("iteration"), "last_refreshed_at": as_of,
        "engagement": F.coalesce("likes", "engagement"), "retweet_count": F.coalesce("reshares", "retweet_count"),
        "reply_count": F.coalesce("comments", "reply_count"), "view_count": F.coalesce("views", "view_count"),
    }).select(*due.columns)
    measured = F.coalesce("likes", "reshares", "comments", "views").isNotNull()
    history = hit.filter(measured).select("source_id", "iteration", as_of.alias("captured_at"), "likes",
                                          "reshares", "comments", "views")
    return patched, history


def velocity(history: DataFrame) -> DataFrame:
    """Change of each metric since the previous pass (at most twelve passes per post)."""
    w = Window.partitionBy("source_id").orderBy("iteration")
    return history.select("source_id", "iteration", "captured_at", *[
        (F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in ("likes", "reshares", "comments", "views")])


def refresh_status(posts: DataFrame, supported=REFRESHABLE_SOURCES) -> DataFrame:
    return posts.groupBy("source").agg(
        F.count(F.lit(1)).alias("posts"),
        F.sum(F.coalesce("refresh_count", F.lit(0)).cast("bigint")).alias("passes")).withColumn(
        "state", F.when(F.col("source").isin(*supported), "LIVE").otherwise("skipped"))


# ---------------------------------------------------------------- alerts, audit
def _alert(kind: str, severity: str, subject: Column, title: Column, detail: Column) -> list[Column]:
    # The id names what the alert is about, so a changed count updates the same alert.
    ident = F.concat(F.lit("alert:"), F.substring(F.md5(F.concat_ws("|", F.lit(kind), subject)), 1, 16))
    return [ident.alias("alert_id"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
            title.alias("title"), detail.alias("detail")]


def emerging(clusters: DataFrame) -> DataFrame:
    t = THRESHOLDS
    return clusters.filter((F.col("recent_share") >= t.emerging_share) & (F.col("avg_score") < 0)
                           & (F.col("size") >= t.emerging_min_size))


def build_alerts(rows: DataFrame, interactions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Emerging issues, elevated fraud, unresolved critical items."""
    share = F.floor(F.col("recent_share") * 100).cast("int")
    rising = emerging(clusters).select(*_alert(
        "emerging", "high", F.col("title"), F.concat(F.lit("Emerging: "), "title"),
        F.format_string("%d mentions, %d%% last 24h, owner %s", "size", share, "top_team")))
    solved = interactions.filter(F.col("resolved") == 1).select(F.col("inbound_source_id").alias("source_id"),
                                                               F.lit(1).alias("_done"))
    totals = rows.join(solved, "source_id", "left").agg(
        F.count_if(F.col("fraud_signal") == 1).alias("fraud"),
        F.count_if((F.col("urgency") == "critical") & F.col("_done").isNull()).alias("critical"))
    fraud = totals.filter(F.col("fraud") >= THRESHOLDS.fraud_alert_min).select(*_alert(
        "fraud", "critical", F.lit("fraud-volume"), F.format_string("Fraud signals elevated (%d)", "fraud"),
        F.lit("impersonation/phishing/scam mentions above threshold")))
    sla = totals.filter(F.col("critical") >= 1).select(*_alert(
        "sla", "critical", F.lit("critical-open"), F.format_string("%d critical items unresolved", "critical"),
        F.lit("urgency=critical with no logged resolution")))
    return rising.unionByName(fraud).unionByName(sla)


def audit_entry(spark, at, actor: str, action: str, detail: str = "") -> DataFrame:
    """One audit row; the id is a digest of time, actor, action and detail."""
    ts = F.lit(at).cast("timestamp")
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
    ident = F.substring(F.md5(F.concat_ws("|", stamp, F.lit(actor), F.lit(action), F.lit(detail))), 1, 16)
    return spark.range(1).select(F.concat(F.lit("aud:"), ident).alias("audit_id"), ts.alias("ts"),
                                 F.lit(actor).alias("actor"), F.lit(action).alias("action"),
                                 F.lit(detail).alias("detail"))
