"""Sharding by extendible hashing, in DataFrame operations only.

A key's hash is 60 bits of its MD5. A bucket is all rows whose hashes begin with the same bits; it splits on one more bit only
while it holds over ``max_bytes`` and more than one row. The buckets that are left are the shards, and the directory says for
every prefix of some length which shard its rows are in.

The directory is built from sums, not row by row: one aggregation gives the bytes of all prefixes of a depth that suffices for
nearly all buckets, its rows are summed up to all shorter prefixes, and a shard is a prefix that fits while the one a bit
shorter does not. Only rows in buckets that are still too large take part in the next, deeper round. Rows that share all 60
bits (one key repeated without end) go on with the bits of a hash of key and row number, so even then every shard fits, but for
single rows that are larger than the limit: these are shards of their own with ``fits`` false.

Null keys hash as the empty string, null texts have no bytes. Sizes are those of UTF-8. No rows, no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmart.session import cut_lineage

from .catalog import query, table

BITS = 60
STEP = 4                # bits by which a later round goes deeper
MAX_BYTES = 1 << 20     # of text in a shard
NODE = ["depth", "prefix"]


def key_hash(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(depth: int) -> Column:
    return F.shiftright("h", BITS - depth)


def _round(rows: DataFrame, above: int, depth: int, max_bytes: int) -> DataFrame:
    """Prefixes of depths above..depth with their bytes and rows, those that fit only if no shorter one here does."""
    cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    nodes = cells.select(F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"), "cell", "b", "n") \
        .select("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix"), "b", "n") \
        .groupBy(*NODE).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_documents")) \
        .withColumn("done", (F.col("shard_bytes") <= max_bytes) | (F.col("shard_documents") == 1))
    parents = nodes.filter(~F.col("done")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    child = nodes.withColumn("parent", F.shiftright("prefix", 1))
    roots = child.filter(F.col("depth") == above)
    return roots.unionByName(child.filter(F.col("depth") > above).join(parents, ["depth", "parent"], "left_semi")).drop("parent")


def directory(rows: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame, DataFrame]]:
    """For each round its depth, its shards (depth, prefix, shard_bytes, shard_documents, done) and the rows that it is about.

    rows: stored, with h and n_bytes. Only totals and the number of buckets that are still too large come to the driver.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    above, depth, rounds = 0, min(BITS, math.ceil(math.log2(total / max_bytes + 1)) + 2), []
    while True:
        nodes = cut_lineage(_round(rows, above, depth, max_bytes), "directory")
        last = depth == BITS
        rounds.append((depth, nodes.filter("done" if not last else f"done OR depth = {depth}"), rows))
        large = nodes.filter(f"NOT done AND depth = {depth}")
        if last or not large.count():
            return rounds
        inside = large.select(F.col("prefix").alias("open"))
        rows = rows.join(inside, _prefix(depth) == F.col("open"), "left_semi")
        above, depth = depth + 1, min(BITS, depth + STEP)


def _assign(rounds: list[tuple[int, DataFrame, DataFrame]]) -> DataFrame:
    """Rows with the shard of their hash. Each round's shards are spelled out as directory entries of its depth."""
    out = None
    for depth, shards, rows in rounds:
        entries = shards.withColumn("entry", F.explode(F.expr(
            f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")))
        found = rows.join(entries, _prefix(depth) == F.col("entry")).drop("entry")
        out = found if out is None else out.unionByName(found)
    return out


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep`` columns, n_bytes, shard, depth, prefix, shard_bytes, shard_documents, fits for every row of ``docs``.

    ``shard`` is "depth:prefix", of rows whose repeated keys overflow "/depth:prefix" of
    the second hash; several such keys may share a shard.
    """
    names = [key, *keep]
    rows = cut_lineage(docs.select(*names, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
                                   key_hash(F.col(key)).alias("h"))
                       .withColumn("row_", F.monotonically_increasing_id()), "sharding")
    placed = _assign(directory(rows, max_bytes)).withColumn("shard", F.concat_ws(":", *NODE))
    crowd = placed.filter(f"depth = {BITS} AND NOT done")
    if not crowd.limit(1).count():
        return _result(placed, names, max_bytes)
    crowd = cut_lineage(crowd.drop("h", "done", "shard_bytes", "shard_documents", *NODE)
                        .withColumn("h", key_hash(F.concat_ws(" ", "shard", "row_"))), "crowd")
    pages = _assign(directory(crowd, max_bytes))
    pages = pages.withColumn("shard", F.concat(F.lit("/"), F.concat_ws(":", *NODE)))
    return _result(placed.filter(f"depth < {BITS} OR done").unionByName(pages.select(placed.columns)), names, max_bytes)


def _result(placed: DataFrame, names: list[str], max_bytes: int) -> DataFrame:
    return placed.select(*names, "n_bytes", "shard", "depth", "prefix", "shard_bytes", "shard_documents",
                         (F.col("shard_bytes") <= max_bytes).alias("fits"))


@query("op2_sharding", f"""
    WITH rows AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
                         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
    spelled AS (SELECT r.*, CAST(d.range AS INTEGER) AS depth, r.h >> CAST({BITS} - d.range AS INTEGER) AS prefix
                FROM rows r, range(0, {BITS + 1}) d),
    nodes AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_documents
              FROM spelled GROUP BY depth, prefix)
    SELECT doc_id, n_bytes, depth || ':' || prefix AS shard, depth, prefix, shard_bytes, shard_documents,
           shard_bytes <= {MAX_BYTES} AS fits
    FROM spelled JOIN nodes USING (depth, prefix)
    WHERE shard_bytes <= {MAX_BYTES} OR shard_documents = 1
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
