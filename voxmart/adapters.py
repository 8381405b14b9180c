"""The driver's tables seen as the engine's contracts.

Each adapter is a list of (expression, name) pairs over one table. The expressions use only
what both engines spell alike, so the same list feeds Spark and the SQL oracle. Scores are
multiples of 1/8: exact in binary, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmart.session import spread

_NEG = "event_id % 9 < 4"
_FRAUD = f"{_NEG} AND event_type = 'error' AND event_id % 5 = 0"
_TW = "event_id % 5 = 0"

MENTIONS = [
    ("concat('ev:', CAST(event_id AS STRING))", "source_id"),
    ("CASE event_id % 5 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' WHEN 2 THEN 'play' "
     "WHEN 3 THEN 'news' ELSE 'technofino' END", "source"),
    ("concat('@u', CAST(user_id AS STRING))", "author"),
    ("CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('User ', CAST(user_id AS STRING), '/', "
     "CAST(event_id % 4 AS STRING)) END", "author_name"),
    ("CAST(ts AS TIMESTAMP)", "created_at"),
    ("CAST(ts AS DATE)", "created_date"),
    ("CAST((event_id % 9 - 4) AS DOUBLE) / 8.0", "score"),
    (f"CASE WHEN {_NEG} THEN 'negative' WHEN event_id % 9 = 4 THEN 'neutral' ELSE 'positive' END",
     "sentiment"),
    (f"CASE WHEN {_FRAUD} THEN 'fraud_report' WHEN {_NEG} AND event_id % 7 = 0 THEN 'churn_threat' "
     f"WHEN {_NEG} THEN 'complaint' WHEN event_id % 9 = 4 THEN 'query' ELSE 'praise' END", "intent"),
    ("CASE WHEN event_id % 9 = 0 AND event_type = 'error' THEN 'critical' WHEN event_id % 9 < 2 THEN 'high' "
     f"WHEN {_NEG} THEN 'medium' ELSE 'low' END", "urgency"),
    ("CASE event_type WHEN 'error' THEN 'app_engineering' WHEN 'purchase' THEN 'payments_upi' "
     "WHEN 'signup' THEN 'customer_support' WHEN 'click' THEN 'cards' ELSE 'none' END", "recommended_team"),
    ("CASE event_type WHEN 'error' THEN 'mobile_internet_banking' WHEN 'purchase' THEN 'upi' "
     "WHEN 'signup' THEN 'deposit_accounts' WHEN 'click' THEN 'credit_card' ELSE 'not_applicable' END",
     "rbi_category"),
    ("CAST(floor(value * 10) AS BIGINT)", "engagement"),
    (f"CASE WHEN {_TW} THEN CAST(floor(value * 40) AS BIGINT) END", "view_count"),
    (f"CASE WHEN {_TW} THEN CAST(floor(value * 3) AS BIGINT) END", "retweet_count"),
    (f"CASE WHEN {_TW} THEN CAST(floor(value) AS BIGINT) END", "reply_count"),
    (f"CASE WHEN {_FRAUD} THEN 1 ELSE 0 END", "fraud_signal"),
    (f"CASE WHEN {_NEG} AND event_id % 7 = 0 THEN 1 ELSE 0 END", "churn_risk"),
    (f"CASE WHEN NOT ({_FRAUD}) THEN 'none' WHEN event_id % 3 = 0 THEN 'phishing' "
     "WHEN event_id % 3 = 1 THEN 'impersonation' END", "fraud_type"),
    ("CASE event_id % 6 WHEN 0 THEN 'credit card' WHEN 1 THEN 'Credit_Card' WHEN 2 THEN 'UPI payments' "
     "WHEN 3 THEN 'home loan' WHEN 4 THEN 'unspecified' END", "product"),
    ("CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('cause ', CAST(event_id % 11 AS STRING)) END", "root_cause"),
    ("concat('action ', CAST(event_id % 5 AS STRING))", "recommended_action"),
    ("CASE WHEN event_id % 5 = 4 THEN '' ELSE concat('theme ', CAST(event_id % 13 AS STRING)) END", "theme"),
    ("concat('post ', CAST(event_id AS STRING), ' about ', event_type)", "summary"),
    ("concat('saw ', event_type, ' with ', props)", "text"),
    ("concat('masked ', CAST(event_id AS STRING))", "text_masked"),
    ("concat('https://posts.example/', CAST(event_id AS STRING))", "url"),
    ("CASE WHEN event_id % 8 < 5 THEN 'lexicon' WHEN event_id % 8 < 7 THEN 'gemini-2.5-flash' "
     "ELSE 'gemini-2.5-flash-lite' END", "model"),
    ("CAST(CASE WHEN event_id % 8 < 5 THEN 3 WHEN event_id % 8 < 7 THEN 6 ELSE 7 END AS DOUBLE) / 8.0", "confidence"),
    ("CASE event_id % 4 WHEN 0 THEN 'joy' WHEN 1 THEN 'anger' WHEN 2 THEN 'fear' ELSE 'neutral' END", "emotion"),
    ("CAST(event_id % 5 + 1 AS INT)", "emotion_intensity"),
    ("CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END", "sarcasm"),
    ("CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END", "pii_present"),
    ("CASE WHEN event_id % 19 = 0 THEN 'phone' ELSE '' END", "pii_types"),
    ("CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE 'hi-en' END", "lang"),
    ("CASE event_id % 7 WHEN 0 THEN 'branch' WHEN 1 THEN 'technical_issue' WHEN 2 THEN 'scam' "
     "WHEN 3 THEN 'praise' WHEN 4 THEN 'charges_dispute' WHEN 5 THEN 'service_delay' END", "issue_category"),
    ("CAST(user_id % 40 AS BIGINT)", "cluster_id"),
    ("CAST(event_id % 13 AS INT)", "refresh_count"),
]

THREADS = [
    ("concat('cv:', CAST(conv_id AS STRING), ':', CAST(turn AS STRING))", "source_id"),
    ("concat('c', CAST(conv_id AS STRING))", "conversation_id"),
    ("CASE WHEN role = 'assistant' THEN '@BankCare' ELSE concat('@c', CAST(conv_id % 40 AS STRING)) END",
     "author"),
    ("conv_id * 1440 + turn * 37", "created_min"),
    ("CASE WHEN conv_id % 2 = 0 THEN 'twitter' ELSE 'reddit' END", "source"),
    ("text", "text"),
    ("CAST((length(text) % 9 - 4) AS DOUBLE) / 8.0", "score"),
    ("CASE WHEN length(text) % 9 < 4 THEN 'negative' WHEN length(text) % 9 = 4 THEN 'neutral' "
     "ELSE 'positive' END", "sentiment"),
]

POSTS = [
    ("concat('doc:', CAST(doc_id AS STRING))", "source_id"), ("source", "source"),
    ("concat('@d', CAST(doc_id % 50 AS STRING))", "author"), ("text", "text"), ("lang", "lang"),
]

CUSTOMERS = [
    ("concat('C', CAST(c_custkey AS STRING))", "customer_key"), ("c_name", "customer_name"),
    ("c_mktsegment", "segment"), ("concat('R', CAST(c_nationkey AS STRING))", "rm_id"),
    ("CAST(c_nationkey AS STRING)", "city"), ("c_acctbal", "clv"),
    ("CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END", "risk_flag"),
    ("CASE c_mktsegment WHEN 'BUILDING' THEN 'Credit Card,Insurance' WHEN 'MACHINERY' THEN 'Fixed Deposit' "
     "WHEN 'HOUSEHOLD' THEN 'Credit Card, Home Loan' WHEN 'AUTOMOBILE' THEN '' ELSE 'Personal Loan' END",
     "products_csv"),
]

BRIDGE = [("concat('@u', CAST(c_custkey AS STRING))", "author"),
          ("concat('C', CAST(c_custkey AS STRING))", "customer_key")]


def _sql(pairs, table: str, where: str = "") -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for e, n in pairs) + f" FROM {table}{where}"


# What the oracle prefixes: the same adapters as common table expressions.
ORACLE_CTES = {
    "mentions": _sql(MENTIONS, "events"),
    "threads": "SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(created_min AS BIGINT)) AS created_at "
               f"FROM ({_sql(THREADS, 'conversations')})",
    "posts": f"SELECT *, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS created_date FROM ("
             f"{_sql(POSTS + [('doc_id', 'doc_id')], 'documents')})",
    "customers": _sql(CUSTOMERS, "customer"),
    "bridge": _sql(BRIDGE, "customer", " WHERE c_custkey % 3 = 0"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _adapt(df: DataFrame, pairs) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for e, n in pairs])


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(table(spark, sf_dir, "events"), MENTIONS)


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _adapt(table(spark, sf_dir, "conversations"), THREADS)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rows.withColumn("created_at", F.timestamp_seconds(F.unix_timestamp(start) + F.col("created_min") * 60))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _adapt(spread(table(spark, sf_dir, "documents")), POSTS + [("doc_id", "doc_id")])
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return rows.withColumn("created_date", day).withColumn("created_at", F.col("created_date").cast("timestamp"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _adapt(table(spark, sf_dir, "customer"), CUSTOMERS)
    held = F.filter(F.transform(F.split("products_csv", ","), F.trim), lambda p: p != "")
    return rows.withColumn("products_held", held).drop("products_csv")


def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('R', CAST(n_nationkey AS STRING)) AS rm_id", "n_name AS rm_name",
        "concat('B', CAST(n_nationkey AS STRING)) AS branch", "CAST(n_regionkey AS STRING) AS region")


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0"), BRIDGE)


def with_ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({ORACLE_CTES[n]})" for n in names) + " "
