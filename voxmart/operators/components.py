"""Connected components of a graph far larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmart.session import remove_path, scratch_path


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id of an edge, component being the smallest id that can be reached.

    Alternating large and small stars: each round hangs the neighbours of a node on the smallest of them, which shortens
    all paths at once, until the edges are stars. Each round is minima by key and one join, and is written to the shared
    folder; only its number of edges and a checksum reach the driver. Edges with a null end are dropped.
    """
    spark = edges.sparkSession
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, place, before = None, None, None
    while True:
        rows = own.distinct() if now is None else _small(_large(now))
        target = scratch_path(spark, "components")
        rows.write.parquet(target)
        now, old, place = spark.read.schema(rows.schema).parquet(target), place, target
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old:
            remove_path(spark, old)
        if before == state:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to its smallest neighbour."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
