"""Numbers as people and sites write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(raw: Column) -> Column:
    """"1.2K", "3M", "1,234" -> integer; anything else -> 0."""
    s = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), ",", "")
    rx = r"(?i)^([0-9.]+)\s*([KMB])?$"
    number = F.regexp_extract(s, rx, 1).try_cast("double")
    factor = (F.when(F.upper(F.regexp_extract(s, rx, 2)) == "K", 1e3)
              .when(F.upper(F.regexp_extract(s, rx, 2)) == "M", 1e6)
              .when(F.upper(F.regexp_extract(s, rx, 2)) == "B", 1e9).otherwise(1.0))
    return F.coalesce((number * factor).cast("bigint"), F.lit(0).cast("bigint"))


def rating(raw: Column) -> Column:
    """"4/5", "4 out of 5 stars", "4.5" -> the first number; none -> 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(raw, F.lit("")), r"([0-9.]+)", 1).try_cast("double"),
                      F.lit(0.0))


def whole(raw: Column) -> Column:
    """"1,234" or "12.0" -> integer; bad -> 0."""
    return F.coalesce(F.regexp_replace(F.trim(raw.cast("string")), ",", "").try_cast("double").cast("bigint"),
                      F.lit(0).cast("bigint"))


def measured(raw: Column) -> Column:
    """Integer or NULL: a metric nobody measured is never 0."""
    return raw.cast("string").try_cast("double").cast("bigint")
