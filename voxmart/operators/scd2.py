"""Slowly changing dimensions, type 2, by the check strategy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmart.config import BRAND, Brand
from voxmart.functions import gates, labels

VALIDITY = ("effective_from", "effective_to", "is_current", "version")
AUTHOR_TRACKED = ("author_name", "influence_tier", "is_customer", "customer_key",
                  "typical_sentiment", "complaint_count")


def _comparable(df: DataFrame, name: str, side: str) -> Column:
    """NULL equals the empty string, and 5.0 equals 5: a mere absence is no change."""
    kind, col = df.schema[name].dataType, F.col(f"{side}.{name}")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(
            F.coalesce(col.cast("string"), F.lit("")))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.coalesce(F.to_json(col), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def merge(history: DataFrame, incoming: DataFrame, key: str, tracked, as_of: Column,
          surrogate: str | None = None) -> DataFrame:
    """New history after seeing ``incoming`` at ``as_of``.

    Unseen keys open version 1; changed rows close the current version and open the next;
    unchanged and missing keys stay. Running it twice changes nothing. One outer join on
    the key yields both the closed and the opened row.
    """
    attributes = [c for c in incoming.columns if c != key]
    current = history.filter(F.col("is_current") == 1)
    pair = current.alias("o").join(incoming.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = reduce(lambda a, b: a | b, [
        _comparable(current, c, "o") != _comparable(incoming, c, "n") for c in tracked])
    old, new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    closes = old & new & changed
    version = F.when(old, F.col("o.version") + 1).otherwise(F.lit(1)).cast("int")
    columns = ([surrogate] if surrogate else []) + [key, *attributes, *VALIDITY]

    def row(values: dict[str, Column]) -> Column:
        return F.struct(*[values[c].cast(history.schema[c].dataType).alias(c) for c in columns])

    kept = {c: F.col(f"o.{c}") for c in columns}
    kept["effective_to"] = F.when(closes, as_of).otherwise(F.col("o.effective_to"))
    kept["is_current"] = F.when(closes, 0).otherwise(F.col("o.is_current"))
    opened = {key: F.col(f"n.{key}"), **{c: F.col(f"n.{c}") for c in attributes},
              "effective_from": as_of, "effective_to": F.lit(None), "is_current": F.lit(1),
              "version": version}
    if surrogate:
        opened[surrogate] = F.concat(F.col(f"n.{key}"), F.lit("#v"), version.cast("string"))
    rows = F.array_compact(F.array(F.when(old, row(kept)),
                                   F.when(new & (~old | closes), row(opened))))
    fresh = pair.select(F.inline(rows))
    past = history.filter(F.coalesce(F.col("is_current"), F.lit(0)) != 1).select(*columns)
    return past.unionByName(fresh)


def author_profile(scored: DataFrame, bridge: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Current attributes per handle: reach tier, latest name, modal tone, complaints, customer."""
    posts = scored.filter((F.coalesce("author", F.lit("")) != "")
                          & ~gates.is_service_account(F.col("author"), brand=brand))
    named = F.when(F.col("author_name").isNotNull(), F.struct("created_at", "source_id"))
    # One row per (author, tone) first: the mode is then picked among four candidates.
    tones = posts.groupBy("author", "sentiment").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.greatest("engagement", "view_count")).alias("reach"),
        F.max(F.struct(named.alias("at"), "author_name")).alias("named"),
        labels.count_where(F.col("intent") == "complaint").alias("complaints"))
    profile = tones.groupBy("author").agg(
        F.max("reach").alias("reach"), F.max("named").alias("named"),
        F.sum("complaints").alias("complaint_count"),
        F.min(F.when(F.col("sentiment").isNotNull(), F.struct((-F.col("n")).alias("n"), "sentiment")))
        .alias("tone"))
    link = bridge.select("author", "customer_key")
    return (profile.join(link, "author", "left").select(
        "author", F.coalesce("named.author_name", "author").alias("author_name"),
        labels.influence_tier(F.col("reach")).alias("influence_tier"),
        F.when(F.col("customer_key").isNotNull(), 1).otherwise(0).alias("is_customer"),
        "customer_key", F.coalesce("tone.sentiment", F.lit("neutral")).alias("typical_sentiment"),
        "complaint_count"))


def build_dim_author(history: DataFrame, scored: DataFrame, bridge: DataFrame, as_of: Column,
                     brand: Brand = BRAND) -> DataFrame:
    """Versioned author dimension, surrogate key ``author#v<n>``."""
    return merge(history, author_profile(scored, bridge, brand), "author", AUTHOR_TRACKED, as_of,
                 surrogate="author_key")
