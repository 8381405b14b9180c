"""Small label rules: tiers, stances, reply types, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmart.config import FOLLOW_UP_INTENTS, NEGATIVE_TONES, THRESHOLDS, URGENT
from voxmart.functions.text import contains_any

# Reply type -> keywords, first hit wins (substring test).
REPLY_KEYWORDS = (
    ("refund", ("refund", "reversed", "credited back")),
    ("escalated", ("dm", "direct message", "escalat", "raised a ticket", "raised the ticket",
                   "team will")),
    ("apology", ("sorry", "apolog", "regret", "inconvenience")),
    ("info", ("please share", "kindly share", "help you", "assist")),
)
# Ranking weights.
URGENCY_RANK = {"critical": 4, "high": 3, "medium": 2}
TRIAGE_URGENCY = {"critical": 4.0, "high": 3.0, "medium": 1.6, "low": 1.0}
TRIAGE_INTENT = {"fraud_report": 3.0, "legal_threat": 3.0, "churn_threat": 2.6, "complaint": 1.8,
                 "query": 1.2, "suggestion": 1.0, "other": 0.8, "praise": 0.3, "spam": 0.1}


def lookup(value: Column, table: dict, default) -> Column:
    """A short fixed mapping as one CASE expression."""
    chain = None
    for key, result in table.items():
        chain = F.when(value == key, result) if chain is None else chain.when(value == key, result)
    return chain.otherwise(default)


def is_negative(sentiment: Column) -> Column:
    return F.coalesce(sentiment.isin(*NEGATIVE_TONES), F.lit(False))


def needs_follow_up(intent: Column, urgency: Column) -> Column:
    return F.coalesce(intent.isin(*FOLLOW_UP_INTENTS), F.lit(False)) | F.coalesce(
        urgency.isin(*URGENT), F.lit(False))


def reply_type(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    chain = None
    for label, words in REPLY_KEYWORDS:
        hit = contains_any(low, words)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("responded")


def influence_tier(reach: Column) -> Column:
    r = F.coalesce(reach, F.lit(0))
    return F.when(r >= 10000, "macro").when(r >= 1000, "mid").when(r >= 100, "micro").otherwise("nano")


def stance(mean_score: Column) -> Column:
    cut = THRESHOLDS.stance_cut
    return F.when(mean_score >= cut, "positive").when(mean_score <= -cut, "negative").otherwise("neutral")


def urgency_rank(urgency: Column) -> Column:
    return lookup(urgency, URGENCY_RANK, 1)


def pct_negative(decimals: int | None = 1) -> Column:
    """Aggregate: share of negative and mixed rows in percent."""
    pct = F.count_if(is_negative(F.col("sentiment"))) * 100 / F.count(F.lit(1))
    return pct if decimals is None else F.round(pct, decimals)


def count_where(condition: Column) -> Column:
    """Aggregate: rows where the condition holds; NULL counts as false."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def flag_sum(flag: str) -> Column:
    return F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0).cast("bigint"))
