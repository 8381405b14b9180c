"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_CATALOGS = ("catalog_facts", "catalog_marts", "catalog_feed", "catalog_text", "catalog_sources",
             "catalog_quality", "catalog_streaming")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``oracle`` only its rows are looked at."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = " ".join(oracle.split())
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _CATALOGS:
        import_module(f"voxmart.plans.{module}")
    return QUERIES, ORACLES
