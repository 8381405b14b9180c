"""Data-quality checks as rows: (check, ok, metric, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmart.schemas import ENUMS


def _checks(measured: DataFrame, checks: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """One aggregated row -> one row per check."""
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"),
                              metric.cast("double").alias("metric"), F.lit(detail).alias("detail"))
                     for name, ok, metric, detail in checks])
    return measured.select(F.inline(rows))


def not_null(df: DataFrame, table: str, column: str) -> DataFrame:
    bad = df.agg(F.count_if(F.col(column).isNull()).alias("n"))
    return _checks(bad, [(f"{table}.{column} not null", F.col("n") == 0, F.col("n"), "rows with NULL")])


def unique(df: DataFrame, table: str, *columns: str) -> DataFrame:
    twice = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    return _checks(twice, [(f"{table}({', '.join(columns)}) unique", F.col("n") == 0, F.col("n"), "keys repeated")])


def accepted(df: DataFrame, table: str, column: str, allowed) -> DataFrame:
    bad = df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).alias("n"))
    return _checks(bad, [(f"{table}.{column} in accepted values", F.col("n") == 0, F.col("n"), "rows outside the list")])


def no_orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    lost = (child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
            .agg(F.count(F.lit(1)).alias("n")))
    return _checks(lost, [(name, F.col("n") == 0, F.col("n"), "rows without a parent")])


def _side_by_side(frames: list[DataFrame]) -> DataFrame:
    """Several one-row aggregates as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def run_checks(raw: DataFrame, analysis: DataFrame, clean: DataFrame, authors: DataFrame, facts: DataFrame,
               interactions: DataFrame, kpis: DataFrame, dates: DataFrame, daily: DataFrame) -> DataFrame:
    """All sixteen checks. Each table is scanned once; only the two orphan checks join."""
    one = lambda df, **aggs: df.agg(*[v.alias(k) for k, v in aggs.items()])
    bad = {f"bad_{c}": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*ENUMS[c])) for c in
           ("sentiment", "urgency", "intent")}
    raw_date = "raw_created_at" if "raw_created_at" in raw.columns else "created_at"
    measured = _side_by_side([
        one(raw, raw=F.count(F.lit(1)), undated=F.count_if(F.col("created_at").isNull()),
            unread=F.count_if(F.col(raw_date).isNotNull() & F.col("created_at").isNull())),
        one(analysis, scored=F.count(F.lit(1)), **bad), one(clean, clean=F.count(F.lit(1))),
        authors.filter(F.col("is_current") == 1).groupBy("author").agg(F.count(F.lit(1)).alias("c"))
        .agg(F.count_if(F.col("c") > 1).alias("dup_current")),
        one(facts, facts=F.count(F.lit(1)), dated=F.count("created_date"), keyed=F.count("date_key")),
        one(interactions, bad_resolved=F.count_if((F.col("resolved") == 1) & F.col("first_response_at").isNull())),
        one(kpis, kpi_rows=F.count(F.lit(1))), one(daily, daily=F.coalesce(F.sum("mentions"), F.lit(0)))])
    c = F.col
    share = F.coalesce(c("undated") * 100 / F.nullif(c("raw"), F.lit(0)), F.lit(0.0))
    fused = _checks(measured, [
        ("raw_posts not empty", c("raw") > 0, c("raw"), "rows"),
        ("analysis coverage >= 95%", (c("raw") == 0) | (c("scored") >= 0.95 * c("raw")), c("scored"), "posts scored"),
        *[(f"{k} enum valid", c(f"bad_{k}") == 0, c(f"bad_{k}"), "rows with an unknown label")
          for k in ("sentiment", "urgency", "intent")],
        ("dim_author: one current row per handle", c("dup_current") == 0, c("dup_current"), "handles with several"),
        ("fact_mention not empty", c("facts") > 0, c("facts"), "rows"),
        ("clean_posts populated", c("clean") > 0, c("clean"), "rows"),
        ("resolved interactions have a response", c("bad_resolved") == 0, c("bad_resolved"), "resolved w/o response"),
        ("mart_kpis has exactly one row", c("kpi_rows") == 1, c("kpi_rows"), "rows"),
        ("fact_mention created_date >= 95%", (c("facts") == 0) | (c("dated") >= 0.95 * c("facts")), c("dated"),
         "dated facts"),
        ("fact_daily reconciles to keyed facts", c("daily") == c("keyed"), c("daily"), "mentions in fact_daily"),
        ("every source date was readable", c("unread") == 0, c("unread"), "dates no format could read"),
        ("undated posts stay under 5% of corpus", share < 5.0, share, "percent without a source date"),
    ])
    return (fused.unionByName(no_orphans(facts, raw, "source_id", "no orphan fact_mention"))
            .unionByName(no_orphans(facts, dates, "date_key", "dim_date covers all fact date_keys")))


def gate(checks: DataFrame) -> DataFrame:
    """One row: may this build be published, and what failed?"""
    return checks.agg(F.bool_and("ok").alias("publish"), F.count_if(F.col("ok")).alias("passed"),
                      F.count(F.lit(1)).alias("total"),
                      F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check")))).alias("failed"))
