"""Corpus pipeline: language ID, quality, near-duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what one returns is written as Parquet
and read again for the next. All but the last return rows of ``documents`` with their columns.

1. language_id    documents whose language cannot be told, or is told with little lead, go
2. quality        documents that the network takes for low quality go
3. near_dedup     of documents whose 64-bit fingerprints of three-word shingles are linked at two bits or fewer one stays
4. decontaminate  documents that cover a benchmark item go
5. pack           the pieces of what is left, with their places in sequences of 1,024 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxmart.llm import decontamination, language_id, packing, quality, simhash, tokens
from voxmart.llm.catalog import table
from voxmart.session import cut_lineage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.public("byte_bpe_50k.json"))


STAGES = [("language_id", language_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage),
          ("decontaminate", decontamination_stage), ("pack", packing_stage)]
ORACLE_SQL = None  # trained models, fingerprints and the search for a packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
