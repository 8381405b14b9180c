"""raw_posts -> clean_posts: normalise, mark copies, language, spam, masked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmart.functions import pii, text
from voxmart.session import cut_lineage
from voxmart.sources.payload import once


def clean(posts: DataFrame) -> DataFrame:
    """Add ``n_urls``, ``clean_text`` and ``text_hash``; the raw text stays as it is."""
    rows = once(posts.drop("n_urls", "clean_text", "text_hash"), n_urls=text.url_count(F.col("text")), clean_text=text.clean_text(F.col("text")))
    return once(rows, text_hash=text.dedup_key(F.col("clean_text")))


def canonical_ids(hashed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``source_id`` of the earliest post per hash; undated posts come last.

    A hash whose canonical row is already stored gets no new one. The aggregate combines
    map-side, so a text copied a billion times sends one row per task, and every later join
    is on a unique key.
    """
    first = F.min(F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "source_id"))
    canon = hashed.groupBy("text_hash").agg(first.alias("first"))
    if stored is not None:
        known = stored.filter(F.col("is_duplicate") == 0).select("text_hash")
        canon = canon.join(known, "text_hash", "left_anti")
    return canon.select(F.col("first.source_id").alias("source_id"))


def mark_duplicates(hashed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``is_duplicate``: 0 on the canonical post of a text, 1 on every other copy.

    ``hashed`` should be stored or cheap: its ids, dates and hashes are read apart from its other columns. Only the ids of the
    copies are joined back.
    """
    narrow = hashed.select("source_id", "created_at", "text_hash")
    copies = narrow.select("source_id").join(canonical_ids(narrow, stored), "source_id", "left_anti")
    return (hashed.join(copies.withColumn("_copy", F.lit(1)), "source_id", "left")
            .withColumn("is_duplicate", F.coalesce("_copy", F.lit(0))).drop("_copy"))


def duplicates(posts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(source_id, text_hash, is_duplicate): texts are read once and only their hashes kept."""
    return mark_duplicates(cut_lineage(clean(posts).select("source_id", "created_at", "text_hash"), "hashes"), stored) \
        .drop("created_at")


def enrich(cleaned: DataFrame) -> DataFrame:
    """All row-wise columns of clean_posts: masked text, language, hash, spam, kinds of personal data."""
    rows = once(cleaned.select("source_id", "created_at", "n_urls", "clean_text", "text_hash"), lang=text.detect_language(F.col("clean_text")), spam_flag=text.spam_flag(F.col("clean_text"), F.col("n_urls")))
    return pii.mask_pii(rows, "clean_text", masked="_masked").select(
        "source_id", "created_at", F.col("_masked").alias("clean_text"), "lang", "text_hash", "spam_flag",
        F.array_join("pii_type_list", ",").alias("pii_types"))


def not_yet(source: DataFrame, done: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of ``source`` with no row in ``done``: the incremental work list."""
    return source.join(done.select(key), key, "left_anti")


def transform_posts(raw: DataFrame, stored: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """The whole stage; with ``stored`` only new posts are processed.

    One pass over the texts writes all row-wise columns to the shared folder; the copies are then found on the stored ids,
    dates and hashes.
    """
    todo = raw if stored is None else not_yet(raw, stored)
    out = mark_duplicates(cut_lineage(enrich(clean(todo)), "clean-posts"), stored).select(
        "source_id", "clean_text", "lang", "text_hash", "is_duplicate", "spam_flag", "pii_types")
    return out if as_of is None else out.withColumn("transformed_at", as_of)


def transform_stats(clean_posts: DataFrame) -> DataFrame:
    """(metric, n): rows, copies, spam, rows with personal data, rows per language."""
    totals = clean_posts.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("is_duplicate") == 1).alias("duplicates"),
        F.count_if(F.col("spam_flag") == 1).alias("spam"),
        F.count_if(F.col("pii_types") != "").alias("with_pii"))
    flat = totals.select(F.expr(
        "stack(4, 'rows', rows, 'duplicates', duplicates, 'spam', spam, 'with_pii', with_pii) as (metric, n)"))
    langs = clean_posts.groupBy(F.concat(F.lit("lang:"), "lang").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return flat.unionByName(langs)


def blocklisted(posts: DataFrame, blocklist: DataFrame, column: str = "text") -> DataFrame:
    """Drop posts whose normalised text is on the blocklist of fingerprints."""
    return (posts.withColumn("fingerprint", text.content_fingerprint(F.col(column)))
            .join(blocklist.select("fingerprint"), "fingerprint", "left_anti").drop("fingerprint"))


def weekly_windows(spark, as_of, days: int, window: int) -> DataFrame:
    """Newest-first [since, until) windows that cover ``days`` before ``as_of``."""
    end, start = F.lit(as_of).cast("date"), F.date_sub(F.lit(as_of).cast("date"), days)
    steps = F.explode(F.sequence(F.lit(0), F.lit(max(days - 1, 0)), F.lit(window)))
    return (spark.range(1).select(steps.alias("back"))
            .select(F.greatest(start, F.date_sub(end, F.col("back") + window)).alias("since"),
                    F.date_sub(end, F.col("back")).alias("until"))
            .orderBy(F.desc("until")))


def date_quality(posts: DataFrame) -> DataFrame:
    """Per source: rows, rows with a raw date, and dates that no format could read."""
    bad = F.col("raw_created_at").isNotNull() & F.col("created_at").isNull()
    return posts.groupBy("source").agg(
        F.count(F.lit(1)).alias("posts"), F.count("raw_created_at").alias("with_date"),
        F.count_if(bad).alias("unparseable"))
