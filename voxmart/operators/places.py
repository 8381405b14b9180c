"""Cities and named entities by keyword, in list order (substring tests on lower-cased text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmart.config import BRAND, CITY_KEYWORDS, Brand


def _low(text: str) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def infer_city(rows: DataFrame, text: str = "text", keywords=CITY_KEYWORDS) -> DataFrame:
    """Add ``city`` and ``region`` of the first keyword of the list that occurs."""
    chain = None
    for word, city, region in keywords:
        place = F.struct(F.lit(city).alias("city"), F.lit(region).alias("region"))
        hit = F.col("_low").contains(word)
        chain = F.when(hit, place) if chain is None else chain.when(hit, place)
    return (rows.withColumn("_low", _low(text)).withColumn("_place", chain)
            .withColumns({"city": F.col("_place.city"), "region": F.col("_place.region")})
            .drop("_low", "_place"))


def extract_entities(rows: DataFrame, text: str = "text", brand: Brand = BRAND, keywords=CITY_KEYWORDS) -> DataFrame:
    """Add ``entities``: every product and city named, each once per post."""
    def found(word: str, name: str, etype: str) -> Column:
        return F.when(F.col("_low").contains(word),
                      F.struct(F.lit(name).alias("entity"), F.lit(etype).alias("etype")))

    hits = [found(p, p.title(), "product") for p in brand.products]
    hits += [found(word, city, "city") for word, city, _ in keywords]
    return (rows.withColumn("_low", _low(text))
            .withColumn("entities", F.array_distinct(F.array_compact(F.array(*hits)))).drop("_low"))
