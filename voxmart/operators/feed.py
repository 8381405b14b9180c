"""Interactive reads: lanes, filter stacks, search, ranking. All predicates fold into one
lazy plan, so they reach the scan and only the requested rows leave the cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmart.config import NEGATIVE_TONES, PRESS_SOURCES, RISK_INTENTS, URGENT
from voxmart.functions import labels
from voxmart.operators.categories import CATEGORY_LABELS
from voxmart.session import cut_lineage

# Filterable fields -> (column, kind), and sortable fields.
FIELDS = {
    "Category": ("issue_category", "cat"), "Intent": ("intent", "cat"), "Sentiment": ("sentiment", "cat"),
    "Urgency": ("urgency", "cat"), "Source": ("source", "cat"), "Team": ("recommended_team", "cat"),
    "Language": ("lang", "cat"), "Likes": ("engagement", "num"), "Reshares": ("retweet_count", "num"),
    "Comments": ("reply_count", "num"), "Views": ("view_count", "num"), "Sentiment score": ("score", "num"),
    "Fraud flag": ("fraud_signal", "bool"), "Churn risk": ("churn_risk", "bool"),
    "PII present": ("pii_present", "bool"),
}
SORTS = {"Newest": "created_at", "Likes": "engagement", "Reshares": "retweet_count", "Comments": "reply_count",
         "Views": "view_count", "Reach": "reach", "Sentiment score": "score"}
GE, LE = "≥", "≤"


# ---------------------------------------------------------------- filters
def _text(value) -> str:
    return str(value)


def _numbers(value) -> tuple[float, float]:
    low, high = value or (0, 0)
    return float(low), float(high)


def _plain(value) -> str:
    return "" if value is None else str(value)


# What a (kind, operator) means: how the value is read, the test of a column, how the value is shown. Operator "" is the one
# of a kind when no other fits.
OPERATORS = {
    ("cat", "is"): (_text, lambda c, v: c.cast("string").eqNullSafe(F.lit(v)), _plain),
    ("cat", "is not"): (_text, lambda c, v: ~c.cast("string").eqNullSafe(F.lit(v)), _plain),
    ("cat", ""): (lambda vs: [str(v) for v in ([vs] if isinstance(vs, str) else vs)],
                  lambda c, vs: F.coalesce(c.cast("string").isin(*vs), F.lit(False)), _plain),
    ("num", GE): (lambda v: float(v or 0), lambda c, v: c.cast("double") >= v, _plain),
    ("num", LE): (lambda v: float(v or 0), lambda c, v: c.cast("double") <= v, _plain),
    ("num", ""): (_numbers, lambda c, v: c.cast("double").between(*v), lambda v: "–".join(f"{x:g}" for x in _numbers(v))),
    ("bool", ""): (lambda v: v in (True, "Yes", 1), lambda c, on: (F.coalesce(c.cast("double"), F.lit(0.0)) > 0) == F.lit(on), _plain),
}


def _operator(f: dict):
    """Column name and the entry of ``OPERATORS`` for a {field, op, value}, or None."""
    column, kind = FIELDS.get(f.get("field"), (None, None))
    return column and (column, OPERATORS.get((kind, f.get("op"))) or OPERATORS[kind, ""], kind)


def condition(rows: DataFrame, f: dict) -> Column | None:
    """Predicate of one {field, op, value}; None for an unknown or unfinished filter."""
    found = _operator(f)
    if not found or found[0] not in rows.columns or (found[2] == "cat" and f.get("value") in (None, "", [])):
        return None
    column, (read, test, _), _ = found
    return test(F.col(column), read(f.get("value")))


def apply_filters(rows: DataFrame, filters) -> DataFrame:
    """All conditions, AND-ed."""
    tests = [c for c in (condition(rows, f) for f in filters or []) if c is not None]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def describe(f: dict) -> str:
    """The filter as a person would read it; empty for an unknown field."""
    found = _operator(f)
    if not found:
        return ""
    column, (_, _, show), _ = found
    names = CATEGORY_LABELS if column == "issue_category" else {}
    value = f.get("value")
    shown = ", ".join(str(names.get(v, v)) for v in value) if isinstance(value, list) else show(names.get(value, value))
    return " ".join(part for part in (f["field"], f.get("op"), shown) if part)


def within(rows: DataFrame, as_of: Column, window: str | None) -> DataFrame:
    """Rolling window 1h / 1d / 1m (30 days); undated rows drop out once a window is set."""
    spans = {"1h": "interval 1 hour", "1d": "interval 1 day", "1m": "interval 30 days"}
    if window not in spans:
        return rows
    return rows.filter(F.col("created_at") >= as_of - F.expr(spans[window]))


def month_options(rows: DataFrame) -> DataFrame:
    """Months with data, newest first."""
    return (rows.filter(F.col("created_at").isNotNull()).select(F.date_trunc("month", "created_at").alias("month"))
            .distinct().orderBy(F.desc("month")))


def in_month(rows: DataFrame, year: int, month: int) -> DataFrame:
    """One calendar month, as a range so that it can prune files."""
    start = F.make_timestamp(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return rows.filter((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("interval 1 month")))


def text_search(rows: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Literal, case-insensitive."""
    return rows.filter(F.contains(F.lower(column), F.lower(F.lit(query)))) if query else rows


def search_mentions(rows: DataFrame, query: str = "", since: str | None = None, fraud_only: bool = False,
                    churn_only: bool = False, limit: int = 50, **equals) -> DataFrame:
    """Substring + equality filters + lower date bound + flags; newest first. ``limit`` is honoured as given."""
    out = text_search(rows, query)
    for column, value in equals.items():
        if value:
            out = out.filter(F.col("recommended_team" if column == "team" else column) == value)
    if since:
        out = out.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if fraud_only:
        out = out.filter(F.col("fraud_signal") == 1)
    if churn_only:
        out = out.filter(F.col("churn_risk") == 1)
    return out.orderBy(F.desc_nulls_last("created_at"), "source_id").limit(int(limit))


def in_lists(rows: DataFrame, fraud: bool = False, churn: bool = False, **lists) -> DataFrame:
    """Several multi-select filters; an empty selection filters nothing."""
    for column, values in lists.items():
        if values:
            rows = rows.filter(F.col(column).isin(*values))
    if fraud:
        rows = rows.filter(F.col("fraud_signal") == 1)
    return rows.filter(F.col("churn_risk") == 1) if churn else rows


LANES = ("all", "gap", "risk", "fraud", "query", "sarcasm", "pii", "press")


def lane(rows: DataFrame, name: str, answered: DataFrame | None = None) -> DataFrame:
    """The eight editorial lanes. ``answered`` holds the ids of posts the brand replied to."""
    risky = F.coalesce(F.col("intent").isin(*RISK_INTENTS), F.lit(False))
    fraud = F.coalesce(F.col("fraud_signal") == 1, F.lit(False))
    unanswered = lambda d: d if answered is None else d.join(
        answered.select("source_id"), "source_id", "left_anti")
    if name == "gap":
        hot = F.coalesce(F.col("urgency").isin(*URGENT), F.lit(False)) | risky | fraud
        return unanswered(rows.filter(hot & (F.col("score") < 0)))
    if name == "risk":
        return rows.filter(fraud | (F.col("churn_risk") == 1) | risky)
    if name == "fraud":
        return rows.filter(fraud)
    if name == "query":
        return unanswered(rows.filter(F.col("intent") == "query"))
    if name == "sarcasm":
        caught = ~is_shallow() & (F.col("score") < -0.5) & (F.col("sentiment") == "negative")
        return rows.filter((F.col("sarcasm") == 1) | caught)
    if name == "pii":
        return rows.filter(F.col("pii_present") == 1)
    if name == "press":
        return rows.filter(F.col("source").isin(*PRESS_SOURCES))
    return rows


def answered_ids(interactions: DataFrame) -> DataFrame:
    return interactions.filter((F.col("n_bank_replies") > 0) & F.col("inbound_source_id").isNotNull()).select(
        F.col("inbound_source_id").alias("source_id"))


def is_shallow() -> Column:
    """True on rows only the lexicon has read."""
    return F.lower(F.coalesce("model", F.lit(""))).contains("lexicon")


# ---------------------------------------------------------------- ranking
def with_triage(rows: DataFrame) -> DataFrame:
    """Urgency x intent x damped reach x severity x flags."""
    reach = F.greatest(F.coalesce("engagement", F.lit(0)), F.coalesce("view_count", F.lit(0)), F.lit(0))
    severity = F.greatest(-F.coalesce("score", F.lit(0.0)), F.lit(0.0)) + 0.35
    flags = 1 + 0.5 * F.coalesce("fraud_signal", F.lit(0)) + 0.3 * F.coalesce("churn_risk", F.lit(0))
    score = (labels.lookup(F.col("urgency"), labels.TRIAGE_URGENCY, 1.0)
             * labels.lookup(F.col("intent"), labels.TRIAGE_INTENT, 0.8)
             * (1 + F.log1p(reach) / 4.0) * severity * flags)
    return rows.withColumns({"reach": reach, "triage": F.round(score, 2)})


def triage(rows: DataFrame, limit: int = 25) -> DataFrame:
    return with_triage(rows).orderBy(F.desc("triage"), "source_id").limit(limit)


def with_priority(rows: DataFrame) -> DataFrame:
    weight = labels.urgency_rank(F.col("urgency"))
    negativity = F.greatest(-F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("priority", F.round(
        weight * (1 + F.sqrt(F.coalesce("engagement", F.lit(0)))) * (0.5 + negativity), 2))


def priority_queue(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Negative or urgent posts by urgency, reach and negativity, with the recommended action."""
    todo = rows.filter(F.col("sentiment").isin(*NEGATIVE_TONES) | F.col("urgency").isin(*URGENT))
    return with_priority(todo).orderBy(F.desc("priority"), "source_id").limit(limit)


def team_worklist(rows: DataFrame, top: int = 40) -> DataFrame:
    """Per team its most urgent open items. The rank limit is applied before the shuffle too."""
    todo = rows.filter(labels.needs_follow_up(F.col("intent"), F.col("urgency"))
                       & F.col("recommended_team").isNotNull())
    rank = F.row_number().over(Window.partitionBy("recommended_team").orderBy(
        F.desc(labels.urgency_rank(F.col("urgency"))), "source_id"))
    return todo.withColumn("rank", rank).filter(F.col("rank") <= top)


def newest(rows: DataFrame, n: int = 30) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("created_at"), "source_id").limit(n)


def sort_by(rows: DataFrame, field: str, ascending: bool = False) -> DataFrame:
    """Any sortable field, NULLs last either way; ties by id."""
    if field == "Triage priority":
        rows, column = with_triage(rows), "triage"
    else:
        column = SORTS[field]
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return rows.orderBy(order, "source_id")


def places(rows: DataFrame, field: str, ascending: bool = False) -> DataFrame:
    """The whole sorted result with ``place``, 1 for the first row. The sort deals rows by range; places are counted within a
    range and moved up by the sizes of the ranges before it, so no task sees more than its range."""
    order = cut_lineage(sort_by(rows, field, ascending).withColumns({
        "_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "places")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = order.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at") - F.shiftleft(F.col("_range").cast("bigint"), 33)
    # One row per range goes to all tasks: a join by range would move all rows, a whole range to one task.
    return order.join(F.broadcast(sizes), "_range").withColumn("place", F.col("_before") + within + 1).drop("_range", "_at", "_before")


def risk_set(rows: DataFrame) -> DataFrame:
    """Posts with fraud, churn or legal exposure, with a short masked excerpt."""
    text = F.coalesce("text_masked", "text")
    return lane(rows, "risk").select(
        "source_id", "source", "author", "intent", "urgency", "score", "fraud_type", "recommended_team",
        text.alias("excerpt"), labels.urgency_rank(F.col("urgency")).alias("urgency_rank"))


def pii_set(rows: DataFrame) -> DataFrame:
    return lane(rows, "pii").select("source_id", "source", "author", "pii_types",
                                    F.col("text_masked").alias("masked_excerpt"))


def loudest(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.filter(F.col("view_count") > 0).orderBy(F.desc("view_count"), "source_id").limit(n)


def recent_fraud(rows: DataFrame, n: int = 30) -> DataFrame:
    return newest(lane(rows, "fraud"), n)


def negative_themes(clusters: DataFrame, n: int = 12) -> DataFrame:
    return clusters.filter((F.col("avg_score") < -0.05) & (F.col("size") >= 3)).orderBy(
        F.desc("size"), "cluster_id").limit(n)


def worst_cities(cities: DataFrame, n: int = 8) -> DataFrame:
    return cities.filter(F.col("mentions") >= 3).orderBy(F.desc("pct_negative"), "city").limit(n)


def page(rows: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    """A bounded page in a fixed order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def point_lookup(rows: DataFrame, **keys) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in keys.items()]))


# ---------------------------------------------------------------- projections
def explorer_frame(rows: DataFrame) -> DataFrame:
    """The export frame: masked text first, display account, category label, NULLs made plain."""
    label = labels.lookup(F.col("issue_category"), {k: F.lit(v) for k, v in CATEGORY_LABELS.items()},
                          F.coalesce("issue_category", F.lit("—")))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    flag = lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0).alias(c)
    return rows.select(
        "source_id", F.coalesce("text_masked", "text").alias("post"),
        F.coalesce("author_name", "author", F.lit("—")).alias("account"), "source", label.alias("category"),
        *[zero(c) for c in ("view_count", "engagement", "retweet_count", "reply_count")], "sentiment",
        F.round("score", 3).alias("score"), F.round("confidence", 2).alias("confidence"), "intent", "urgency",
        F.when(~is_shallow(), F.col("emotion")).alias("emotion"), "recommended_team", "product",
        *[flag(c) for c in ("fraud_signal", "churn_risk", "pii_present")], "model")


def feed(rows: DataFrame, lane_name: str = "all", answered: DataFrame | None = None, month=None,
         category: str | None = None, query: str = "", filters=(), sort: str = "Triage priority",
         ascending: bool = False, limit: int = 25) -> DataFrame:
    """Lane -> month -> category -> text -> filter stack -> sort -> page."""
    out = lane(rows, lane_name, answered)
    if month is not None:
        out = in_month(out, *month)
    if category:
        out = out.filter(F.col("issue_category") == category)
    return sort_by(apply_filters(text_search(out, query), filters), sort, ascending).limit(limit)


def lane_strip(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("posts"), F.avg("score").alias("avg_score"),
                    F.count_if(F.col("urgency") == "critical").alias("critical"),
                    labels.flag_sum("fraud_signal").alias("fraud_flags"),
                    F.count_if(~is_shallow()).alias("deep_read"))


def read_only_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """One query over the registered views. The session's own parser decides: what is no single query (commands, writes, several
    statements) is refused before anything runs. Without ``limit`` the result is whole."""
    body = (sql or "").strip().rstrip(";")
    try:
        spark._jsparkSession.sessionState().sqlParser().parseQuery(body)
    except Exception as e:
        raise ValueError("only a single query is allowed") from e
    out = spark.sql(body)
    return out if limit is None else out.limit(limit)
