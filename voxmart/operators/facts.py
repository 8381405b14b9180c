"""Posts + analysis -> facts. Every join is an equi-join; nothing is collected per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmart.config import BRAND, Brand
from voxmart.functions import gates, labels

SCORED_COLUMNS = ("sentiment", "score", "emotion", "urgency", "intent", "recommended_team",
                  "fraud_signal", "churn_risk", "theme", "summary", "model")


def scored_posts(posts: DataFrame, analysis: DataFrame) -> DataFrame:
    """Every post with its analysis where there is one."""
    return posts.join(analysis.select("source_id", *SCORED_COLUMNS), "source_id", "left").select(
        "source_id", "source", "author", "author_name", "created_at", "url", "text",
        *SCORED_COLUMNS, "engagement", "view_count")


def mentions(posts: DataFrame, analysis: DataFrame) -> DataFrame:
    """Analysed posts only, all columns of both sides."""
    extra = [c for c in analysis.columns if c == "source_id" or c not in posts.columns]
    return posts.join(analysis.select(*extra), "source_id")


def customer_voice(rows: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Without the brand's own accounts; posts without an author stay."""
    name = F.col("author_name") if "author_name" in rows.columns else None
    return rows.filter(~gates.is_service_account(F.col("author"), name, brand))


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def fact_mention(rows: DataFrame, bridge: DataFrame, authors: DataFrame | None = None,
                 brand: Brand = BRAND) -> DataFrame:
    """One row per analysed customer post with its dimension keys."""
    facts = (customer_voice(rows, brand)
             .withColumns({"created_date": F.to_date("created_at"),
                           "date_key": date_key(F.col("created_at")), "source_key": F.col("source")})
             .join(bridge.select("author", "customer_key"), "author", "left"))
    if authors is None:
        return facts.withColumn("author_key", F.lit(None).cast("string"))
    current = authors.filter(F.col("is_current") == 1).select("author", "author_key")
    return facts.join(current, "author", "left")


def author_as_of(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """The author's version that was valid when the post was written.

    An equi-join on the handle narrows first; the validity interval is a residual filter
    over that handle's few versions.
    """
    versions = authors.select(F.col("author").alias("_a"), "author_key", "influence_tier", "version",
                              "effective_from", "effective_to")
    inside = ((F.col("created_at") >= F.col("effective_from"))
              & (F.col("effective_to").isNull() | (F.col("created_at") < F.col("effective_to"))))
    return rows.join(versions, (F.col("author") == F.col("_a")) & inside, "left").drop(
        "_a", "effective_from", "effective_to")


def fact_aspect_sentiment(rows: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """One row per post and aspect; evidence is kept to 300 characters."""
    return (customer_voice(rows, brand).select("source_id", F.explode("aspects").alias("a"))
            .select("source_id", "a.aspect", "a.sentiment",
                    F.coalesce("a.evidence", F.lit("")).alias("evidence")))


def fact_interaction(posts: DataFrame, bridge: DataFrame | None = None, brand: Brand = BRAND) -> DataFrame:
    """One row per conversation a customer opened: was it answered, resolved, liked?

    A single aggregation with first/last picks. The follow-up is the customer's last dated
    post, if it is later than the first reply, so no second pass over the thread is needed
    and a viral thread combines map-side like any other key.
    """
    rows = posts.filter(F.coalesce("conversation_id", F.lit("")) != "").withColumn(
        "_own", gates.is_service_account(F.col("author"), brand=brand))
    order = F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "source_id")
    own, customer = F.col("_own"), ~F.col("_own")
    threads = rows.groupBy("conversation_id").agg(
        F.min(F.when(customer, F.struct(order.alias("o"), "source", "author", "source_id", "score",
                                        "created_at"))).alias("inbound"),
        F.min(F.when(own, F.struct(order.alias("o"), "created_at",
                                   labels.reply_type(F.col("text")).alias("reply")))).alias("response"),
        F.max(F.when(customer & F.col("created_at").isNotNull(),
                     F.struct("created_at", "source_id", "score", "sentiment"))).alias("last"),
        F.count_if(own).alias("n_bank_replies")).filter(F.col("inbound").isNotNull())
    answered = F.col("response.created_at").isNotNull()
    follows = answered & (F.col("last.created_at") > F.col("response.created_at"))
    post_score = F.when(follows, F.col("last.score"))
    happy = ((F.coalesce("last.sentiment", F.lit("")) == "positive")
             | (F.coalesce("last.score", F.lit(0.0)) > 0.2))
    satisfied = F.when(follows, F.when(happy, 1).otherwise(0))
    kind = F.when(F.col("response").isNotNull(), F.col("response.reply")).otherwise("none")
    seconds = (F.unix_micros("response.created_at") - F.unix_micros("inbound.created_at")) / 1e6
    out = threads.select(
        F.concat(F.lit("conv:"), "conversation_id").alias("issue_id"), "conversation_id",
        F.col("inbound.source").alias("source"), F.col("inbound.author").alias("author"),
        F.col("inbound.source_id").alias("inbound_source_id"),
        F.col("inbound.created_at").alias("opened_at"),
        F.col("response.created_at").alias("first_response_at"),
        F.round(seconds / 60, 1).alias("response_latency_min"), "n_bank_replies",
        F.when(answered & ((F.coalesce(satisfied, F.lit(0)) == 1) | kind.isin("refund", "escalated")), 1)
        .otherwise(0).alias("resolved"),
        satisfied.alias("customer_satisfied"), kind.alias("resolution_type"),
        F.col("inbound.score").alias("inbound_score"), post_score.alias("post_response_score"),
        F.round(post_score - F.col("inbound.score"), 3).alias("recovery_delta"))
    if bridge is None:
        return out.withColumn("customer_key", F.lit(None).cast("string"))
    return out.join(bridge.select("author", "customer_key"), "author", "left")


def fact_daily(facts: DataFrame) -> DataFrame:
    """Day x source x tone; a missing source or tone is a group of its own."""
    return facts.filter(F.col("date_key").isNotNull()).groupBy("date_key", "source_key", "sentiment").agg(
        F.count(F.lit(1)).alias("mentions"), F.round(F.avg("score"), 3).alias("avg_score"),
        F.count_if(labels.is_negative(F.col("sentiment"))).alias("negatives"),
        labels.count_where(F.col("intent") == "complaint").alias("complaints"),
        labels.flag_sum("fraud_signal").alias("fraud_ct"), labels.flag_sum("churn_risk").alias("churn_ct"))


def daily_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date_key").agg(*[
        F.sum(c).alias(c) for c in ("mentions", "negatives", "complaints", "fraud_ct", "churn_ct")])
