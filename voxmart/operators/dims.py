"""Conformed dimensions and the denormalised views over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmart.config import CATEGORY_SEED, SOURCE_SEED, TEAM_SEED
from voxmart.schemas import SCHEMAS


def dim_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCE_SEED), SCHEMAS["dim_source"])


def dim_team(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEAM_SEED), SCHEMAS["dim_team"])


def dim_category(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORY_SEED), SCHEMAS["dim_category"])


def dim_date(facts: DataFrame, day: str = "created_date") -> DataFrame:
    """One row per calendar day between the first and the last fact; ISO week, Monday = 0."""
    span = facts.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter(F.col("lo").isNotNull())
    d = F.col("full_date")
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("full_date")).select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "full_date",
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMM").alias("month_name"), F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day"), F.weekday(d).alias("day_of_week"),
        F.date_format(d, "EEE").alias("day_name"),
        F.when(F.weekday(d) >= 5, 1).otherwise(0).alias("is_weekend"))


def vw_mention(facts: DataFrame, analysis: DataFrame, dates: DataFrame, sources: DataFrame,
               authors: DataFrame, teams: DataFrame, categories: DataFrame) -> DataFrame:
    """Facts with every dimension. Only the seeded dimensions, whose size is fixed, are
    broadcast; authors, dates and analysis are left to the optimizer's own size check."""
    detail = analysis.select("source_id", "emotion", "sarcasm", "theme", "root_cause", "fraud_type", "summary")
    days = dates.select("date_key", "year", "month", "month_name", "week", "day_name", "is_weekend")
    tier = authors.select("author_key", "influence_tier", "is_customer")
    return (facts.drop("emotion", "sarcasm", "theme", "root_cause", "fraud_type", "summary")
            .join(detail, "source_id", "left").join(days, "date_key", "left")
            .join(sources.select("source_key", "source_type", "medium", "reliability"),
                  "source_key", "left")
            .join(tier, "author_key", "left")
            .join(teams.select(F.col("team_code").alias("recommended_team"), "team_name",
                                           "sla_hours", "is_escalation"), "recommended_team", "left")
            .join(categories.select(F.col("category_code").alias("rbi_category"),
                                                "category_name", "is_regulatory", "severity"),
                  "rbi_category", "left"))


def vw_daily_sentiment(daily: DataFrame, dates: DataFrame, sources: DataFrame) -> DataFrame:
    days = dates.select("date_key", "full_date", "year", "month", "week", "day_name", "is_weekend")
    return (daily.join(days, "date_key", "left")
            .join(sources.select("source_key", "source_name", "source_type"), "source_key", "left"))


def unmatched_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Source labels that an inner join with the dimension would silently drop."""
    return (facts.join(sources, "source_key", "left_anti")
            .groupBy("source_key").agg(F.count(F.lit(1)).alias("mentions")))


def public_source_count(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct sources that are not the internal employee channel."""
    kinds = sources.select(F.col("source_key").alias("source"), "source_type")
    return (posts.join(kinds, "source", "left")
            .filter(F.coalesce("source_type", F.lit("")) != "employee")
            .agg(F.count_distinct("source").alias("public_sources")))
