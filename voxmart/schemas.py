"""Table contracts: one explicit StructType per table, and schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASPECTS = "array<struct<aspect:string,sentiment:string,evidence:string>>"

# The types contracts use. Spelled out here, so that importing the package needs no session.
_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
    "aspects": T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("aspect", "sentiment", "evidence")])),
}

_COLUMNS = {
    "raw_posts": """
        source_id string, source string, author string, author_name string, text string,
        url string, created_at timestamp, fetched_at timestamp, lang string,
        engagement bigint, reply_count bigint, retweet_count bigint, quote_count bigint,
        view_count bigint, bookmark_count bigint, conversation_id string, raw_json string,
        rating double, refresh_count int, last_refreshed_at timestamp""",
    "clean_posts": """
        source_id string, clean_text string, lang string, text_hash string,
        is_duplicate int, spam_flag int, pii_types string, transformed_at timestamp""",
    "analysis": """
        source_id string, sentiment string, score double, emotion string,
        emotion_intensity int, sarcasm int, intent string, urgency string,
        urgency_reason string, product string, root_cause string, rbi_category string,
        recommended_team string, recommended_action string, churn_risk int,
        fraud_signal int, fraud_type string, pii_present int, theme string,
        summary string, confidence double, aspects aspects, cluster_id bigint,
        model string, analyzed_at timestamp, text_masked string, pii_types string,
        issue_category string, category_reason string""",
    "clusters": """
        cluster_id bigint, title string, size bigint, recent_share double,
        avg_score double, top_team string, sample_ids strings, updated_at timestamp""",
    "engagement_history": """
        source_id string, iteration int, captured_at timestamp, likes bigint,
        reshares bigint, comments bigint, views bigint""",
    "dim_author": """
        author_key string, author string, author_name string, influence_tier string,
        is_customer int, customer_key string, typical_sentiment string,
        complaint_count bigint, effective_from timestamp, effective_to timestamp,
        is_current int, version int""",
    "dim_customer": """
        customer_key string, customer_name string, segment string, rm_id string,
        city string, clv double, risk_flag int, products_held strings,
        updated_at timestamp""",
    "dim_rm": "rm_id string, rm_name string, branch string, region string",
    "dim_product": "product_code string, product_name string, category string",
    "bridge_handle_customer": """
        author string, customer_key string, match_method string, confidence double,
        verified_by string, effective_from timestamp, effective_to timestamp""",
    "dim_source": """
        source_key string, source_name string, source_type string, medium string,
        is_keyless int, reliability string""",
    "dim_team": """
        team_code string, team_name string, owner_role string, sla_hours int,
        is_escalation int""",
    "dim_category": """
        category_code string, category_name string, is_regulatory int, severity string""",
    "fact_mention": """
        source_id string, author string, author_key string, customer_key string,
        source string, created_date date, sentiment string, score double,
        emotion_intensity int, intent string, urgency string, recommended_team string,
        rbi_category string, product string, engagement bigint, view_count bigint,
        confidence double, churn_risk int, fraud_signal int, pii_present int,
        cluster_id bigint, date_key int, source_key string""",
    "fact_aspect_sentiment": """
        source_id string, aspect string, sentiment string, evidence string""",
    "fact_interaction": """
        issue_id string, conversation_id string, source string, customer_key string,
        author string, inbound_source_id string, opened_at timestamp,
        first_response_at timestamp, response_latency_min double, n_bank_replies bigint,
        resolved int, customer_satisfied int, resolution_type string,
        inbound_score double, post_response_score double, recovery_delta double""",
    "fact_daily": """
        date_key int, source_key string, sentiment string, mentions bigint,
        avg_score double, negatives bigint, complaints bigint, fraud_ct bigint,
        churn_ct bigint""",
    "competitor_posts": """
        source_id string, brand string, source string, author string, text string,
        url string, created_at timestamp, sentiment string, score double,
        fetched_at timestamp""",
    "reply_drafts": "source_id string, draft string, model string, created_at timestamp",
    "translations": """
        source_id string, lang string, english string, model string, created_at timestamp""",
    "alerts": """
        alert_id string, kind string, severity string, title string, detail string,
        ref_url string, created_at timestamp, sent int""",
    "audit_log": "audit_id string, ts timestamp, actor string, action string, detail string",
    "eval_history": "run_ts timestamp, metric string, value double",
    "run_metrics": """
        run_ts timestamp, mentions bigint, model_calls bigint, tokens_est bigint,
        cost_usd_est double, provider string""",
}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in
                         (column.split() for column in columns.split(","))])


SCHEMAS: dict[str, T.StructType] = {name: _struct(columns) for name, columns in _COLUMNS.items()}

# The allowed labels of each enumerated column, first the default used
# when a model emits anything else.
ENUMS: dict[str, tuple[str, ...]] = {
    "sentiment": ("neutral", "positive", "negative", "mixed"),
    "emotion": ("neutral", "anger", "frustration", "fear", "disappointment", "joy",
                "gratitude", "other"),
    "urgency": ("low", "medium", "high", "critical"),
    "intent": ("other", "complaint", "query", "praise", "churn_threat", "legal_threat",
               "fraud_report", "journalist_or_influencer", "suggestion", "spam"),
    "aspect": ("other", "mobile_app", "internet_banking", "upi_payments", "cards", "loans",
               "accounts", "branch_atm", "customer_support", "fees_charges",
               "fraud_security"),
    "recommended_team": ("none", "app_engineering", "cards", "payments_upi", "loans",
                         "branch_ops", "customer_support", "fraud_cyber", "retention",
                         "comms_pr"),
    "rbi_category": ("not_applicable", "atm_debit_card", "credit_card",
                     "mobile_internet_banking", "upi", "loans_advances",
                     "deposit_accounts", "mis_selling", "levy_of_charges", "other"),
}


def align(df: DataFrame, table: str | T.StructType) -> DataFrame:
    """Project ``df`` onto a contract: missing columns become typed NULLs, NaN becomes NULL.

    This is how additive schema evolution works here: an older file simply lacks the
    newer columns.
    """
    schema = SCHEMAS[table] if isinstance(table, str) else table
    have = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name not in have:
            col = F.lit(None).cast(field.dataType)
        else:
            col = F.col(field.name).cast(field.dataType)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                col = F.when(~F.isnan(col), col)
        cols.append(col.alias(field.name))
    return df.select(*cols)


def empty(spark, table: str) -> DataFrame:
    """An empty table with its contract's schema."""
    return spark.createDataFrame([], SCHEMAS[table])
