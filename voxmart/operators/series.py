"""Daily series: anomalies, forecast, rolling rates. Windows only ever run on daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmart.config import THRESHOLDS


def daily_volume(rows: DataFrame, key: str = "category") -> DataFrame:
    """Dated mentions per key and day with the mean score."""
    return rows.filter(F.col("day").isNotNull()).groupBy(key, "day").agg(
        F.count(F.lit(1)).alias("mentions"), F.avg("score").alias("mean"))


def with_category_day(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"day": F.to_date("created_at"),
                             "category": F.coalesce("rbi_category", F.lit("not_applicable"))})


def trends(rows: DataFrame) -> DataFrame:
    """z-score of each day's volume within its category; anomaly = spike with a negative mean."""
    w = Window.partitionBy("category")
    spread = F.stddev_pop("mentions").over(w)
    z = F.when(spread == 0, 0.0).otherwise(F.round((F.col("mentions") - F.avg("mentions").over(w)) / spread, 2))
    out = daily_volume(with_category_day(rows)).withColumn("z_score", z)
    spike = (F.col("z_score") >= THRESHOLDS.anomaly_z) & (F.col("mean") < 0)
    return out.select("day", "category", "mentions", F.round("mean", 3).alias("avg_score"), "z_score",
                      F.when(spike, 1).otherwise(0).alias("anomaly"))


def forecast(daily: DataFrame, key: str = "category", horizon: int = 3) -> DataFrame:
    """Least-squares line over the ordinal of present days, extended by ``horizon`` days."""
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("day")) - 1
    fit = daily.withColumn("x", ordinal).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("day").alias("last"),
        F.regr_slope("mentions", "x").alias("slope"), F.regr_intercept("mentions", "x").alias("intercept"))
    cut = THRESHOLDS.forecast_slope
    trend = F.when(F.col("slope") > cut, "rising").when(F.col("slope") < -cut, "falling").otherwise("flat")
    ahead = fit.filter(F.col("n") >= 2).select(
        key, "last", "slope", "intercept", "n", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"))
    value = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") + F.col("h")))
    return ahead.select(key, F.date_add("last", F.col("h") + 1).alias("horizon_day"),
                        F.round(value, 1).alias("predicted_mentions"), trend.alias("trend"))


def fill_calendar(daily: DataFrame, dates: DataFrame, key: str = "category") -> DataFrame:
    """Every key gets every day of the calendar, with zero mentions where it had none.

    The calendar of a key is generated from the span of days, not by joining all keys with
    all days."""
    span = dates.agg(F.min("full_date").alias("lo"), F.max("full_date").alias("hi"))
    keys = daily.select(key).distinct()
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    grid = keys.select(key, F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias("day"))
    return grid.join(daily, [key, "day"], "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def rolling_negative_rate(totals: DataFrame, days: int = 120, width: int = 7) -> DataFrame:
    """Negative rate per day and its mean over the last ``width`` rows (at least two)."""
    d = totals.withColumn("day", F.to_date(F.col("date_key").cast("string"), "yyyyMMdd"))
    recent = d.filter(F.col("day") >= F.date_sub(d.agg(F.max("day")).scalar(), days))
    rate = recent.withColumn("neg_rate", F.col("negatives") * 100 / F.greatest("mentions", F.lit(1)))
    # One row per day: a single ordered window is small by construction.
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(-(width - 1), 0)
    return rate.select("day", "mentions", "neg_rate",
                       F.when(F.count("neg_rate").over(w) >= 2, F.avg("neg_rate").over(w)).alias("roll"))
