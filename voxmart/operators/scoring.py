"""Sentiment: a lexicon baseline for every post, and the merge of deeper model results."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmart.config import LEXICON_MODEL
from voxmart.functions import pii
from voxmart.functions.text import contains_any
from voxmart.schemas import ASPECTS, ENUMS

# What runs inside tasks travels with them, whether or not the workers have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Keywords of the baseline, and the published weights of the valence rules.
RISK_WORDS = ("fraud", "scam", "otp", "phish", "cheat", "stolen", "lawyer", "court", "ombudsman", "legal",
              "refund", "fail", "debited", "stuck", "not working", "down", "blocked", "charged", "unauthori",
              "complaint", "kyc", "hack", "block", "error", "crash")
FRAUD_WORDS = ("fraud", "scam", "otp", "phish", "cheat", "stolen", "hack", "kyc", "fake")
NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "nowhere", "without", "cannot", "cant",
             "dont", "doesnt", "didnt", "isnt", "wasnt", "wont", "hardly", "rarely")
BOOSTERS = ("very", "really", "extremely", "absolutely", "completely", "so", "totally", "incredibly")
DAMPENERS = ("slightly", "somewhat", "barely", "kinda", "partly", "marginally")
BOOST, NEGATE, EXCLAIM, ALPHA = 293, -740, 292, 15.0  # thousandths, but for ALPHA
WORD = r"[\p{L}\p{N}']+"


def lexicon_scores(posts: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "source_id") -> DataFrame:
    """(key, score): word valences, damped or flipped by the words before, normalised to [-1, 1].

    Words look back three places inside their own row; then equal hits of a row are counted
    before the shuffle. Sums are kept in whole thousandths, so the result does not depend on
    the order of addition.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    look = F.transform("words", lambda w, i: F.struct(
        w.alias("term"),
        F.coalesce(F.get("words", i - 1).isin(*BOOSTERS), F.lit(False)).alias("up"),
        F.coalesce(F.get("words", i - 1).isin(*DAMPENERS), F.lit(False)).alias("down"),
        (F.coalesce(F.get("words", i - 1).isin(*NEGATIONS), F.lit(False))
         | F.coalesce(F.get("words", i - 2).isin(*NEGATIONS), F.lit(False))
         | F.coalesce(F.get("words", i - 3).isin(*NEGATIONS), F.lit(False))).alias("negated")))
    tokens = (posts.select(key, words.alias("words"))
              .select(key, F.inline(look)))
    terms = lexicon.select(F.lower("term").alias("term"), F.round(F.col("valence") * 1000).cast("bigint").alias("v"))
    sign = F.signum("v").cast("bigint")
    raised = F.col("v") + F.when(F.col("up"), sign * BOOST).when(F.col("down"), sign * -BOOST).otherwise(0)
    # Thousandths of thousandths only where a negation multiplies.
    micro = F.when(F.col("negated"), raised * NEGATE).otherwise(raised * 1000)
    sums = tokens.join(terms, "term").groupBy(key).agg(F.sum(micro).alias("micro"))
    bangs = F.least(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("!")), F.lit(4)) * EXCLAIM * 1000
    joined = posts.select(key, bangs.cast("bigint").alias("bangs")).join(sums, key, "left")
    total = F.coalesce("micro", F.lit(0))
    emphasised = (total + F.signum(total).cast("bigint") * F.col("bangs")) / 1e6
    return joined.select(key, F.round(emphasised / F.sqrt(emphasised * emphasised + ALPHA), 3).alias("score"))


def tone(score: Column) -> Column:
    return F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").otherwise("neutral")


def baseline_rows(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """A complete analysis row per post from the score and the keyword lists."""
    rows = posts.join(scores, "source_id").withColumn("sentiment", tone(F.col("score")))
    rows = pii.masked_fields(rows, "text")
    low = F.lower(F.coalesce("text", F.lit("")))
    pos, neg = F.col("sentiment") == "positive", F.col("sentiment") == "negative"
    risky, fraud = contains_any(low, RISK_WORDS), contains_any(low, FRAUD_WORDS)
    return rows.select(
        "source_id", "sentiment", "score",
        F.when(pos, "joy").when(neg & risky, "anger").otherwise("neutral").alias("emotion"),
        F.when(neg, 3).otherwise(2).alias("emotion_intensity"), F.lit(0).alias("sarcasm"),
        F.when(pos, "praise").when(neg, "complaint").otherwise("other").alias("intent"),
        F.when(neg & risky, "high").when(neg, "medium").otherwise("low").alias("urgency"),
        F.when(pos, "lexicon (clear positive)").otherwise("lexicon baseline (pending depth)").alias("urgency_reason"),
        F.lit("unspecified").alias("product"), F.lit("").alias("root_cause"),
        F.lit("not_applicable").alias("rbi_category"), F.lit("none").alias("recommended_team"),
        F.lit("").alias("recommended_action"), F.lit(0).alias("churn_risk"),
        F.when(fraud, 1).otherwise(0).alias("fraud_signal"),
        F.when(fraud, "suspected").otherwise("none").alias("fraud_type"), "pii_present",
        F.lit("").alias("theme"), F.col("text_masked").alias("summary"),
        F.lit(0.4).alias("confidence"), F.expr(f"cast(array() as {ASPECTS})").alias("aspects"),
        F.lit(None).cast("bigint").alias("cluster_id"), F.lit(LEXICON_MODEL).alias("model"),
        "text_masked", "pii_types")


def needs_depth(analysis: DataFrame) -> DataFrame:
    """Baseline rows worth a deeper read: everything that is not clearly positive."""
    return analysis.filter((F.col("model") == LEXICON_MODEL) & (F.col("sentiment") != "positive"))


def split_by_depth(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(light, deep)."""
    return analysis.filter(F.col("sentiment") == "positive"), analysis.filter(F.col("sentiment") != "positive")


def score_or_refuse(posts: DataFrame, scorer: Callable[[list[dict]], list[dict]], schema: T.StructType, batch: int = 12) -> DataFrame:
    """Run an external scorer over masked posts, ``batch`` rows per call, inside the tasks: rows of ``schema`` and ``error``.

    A batch that fails, and a post that an answer leaves out, give a row of the id and the error, all else null: nothing is lost
    uncounted.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    columns = to_arrow_schema(out)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch).to_pylist()
                try:
                    results, error = scorer(part) or [], "left out of the answer"
                except Exception as e:  # an unreachable scorer must not lose the partition
                    results, error = [], f"{type(e).__name__}: {e}"
                told = {r.get("source_id") for r in results}
                refused = [{"source_id": r["source_id"], "error": error} for r in part if r["source_id"] not in told]
                yield pa.RecordBatch.from_pylist([*({**r, "error": None} for r in results), *refused], schema=columns)

    return posts.mapInArrow(run, out)


def score_batches(posts: DataFrame, scorer: Callable[[list[dict]], list[dict]], schema: T.StructType, batch: int = 12) -> DataFrame:
    """The scored rows of ``score_or_refuse``; posts that were refused keep their baseline."""
    return score_or_refuse(posts, scorer, schema, batch).filter("error IS NULL").drop("error")


def _enum(value: Column, name: str) -> Column:
    allowed = ENUMS[name]
    return F.when(value.isin(*allowed), value).otherwise(F.lit(allowed[0]))


# Where a model's answer may hold its list of records.
CONTAINERS = ("results", "posts", "analysis", "items", "data")


def coerce_outputs(outputs: DataFrame, output: str = "output", ids: str = "ids") -> DataFrame:
    """Raw model answers -> valid analysis records.

    ``output`` is the answer's JSON, ``ids`` the posts that were asked about, in order. A
    record without an id takes the one at its position, but only if the counts agree.
    Unknown labels fall back to the default, numbers are clamped.
    """
    blob = F.regexp_replace(F.trim(output), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    doc = F.try_parse_json(blob)
    as_list = lambda path: F.try_variant_get(F.col("_doc"), path, "array<variant>")
    single = F.when(F.try_variant_get(F.col("_doc"), "$.source_id", "string").isNotNull()
                    | F.try_variant_get(F.col("_doc"), "$.sentiment", "string").isNotNull(),
                    F.array(F.col("_doc")))
    items = F.coalesce(as_list("$"), *[as_list(f"$.{k}") for k in CONTAINERS], single)
    rows = (outputs.withColumn("_doc", doc).withColumn("_items", items)
            .select(ids, F.size("_items").alias("_n"), F.posexplode("_items").alias("_pos", "_r")))
    text = lambda k: F.try_variant_get(F.col("_r"), f"$.{k}", "string")
    num = lambda k: F.try_variant_get(F.col("_r"), f"$.{k}", "double")

    def flag(key: str) -> Column:
        raw = text(key)
        falsy = raw.isNull() | F.lower(raw).isin("", "false", "0", "0.0", "null")
        return F.when(falsy, 0).otherwise(1)

    def clamp(value: Column, lo: float, hi: float) -> Column:
        return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))

    aspects = F.transform(
        F.coalesce(F.try_variant_get(F.col("_r"), "$.aspects", "array<variant>"),
                   F.expr("cast(array() as array<variant>)")),
        lambda a: F.struct(
            _enum(F.coalesce(F.try_variant_get(a, "$.aspect", "string"), F.lit("other")), "aspect").alias("aspect"),
            _enum(F.coalesce(F.try_variant_get(a, "$.sentiment", "string"), F.lit("neutral")), "sentiment")
            .alias("sentiment"),
            F.coalesce(F.try_variant_get(a, "$.evidence", "string"), F.lit(""))
            .alias("evidence")))
    fallback = F.when(F.col("_n") == F.size(ids), F.get(ids, F.col("_pos")))
    record = rows.select(
        F.coalesce(F.nullif(text("source_id"), F.lit("")), fallback).alias("source_id"),
        *[_enum(text(c), c).alias(c) for c in
          ("sentiment", "emotion", "urgency", "intent", "rbi_category", "recommended_team")],
        clamp(F.coalesce(num("score"), F.lit(0.0)), -1.0, 1.0).alias("score"),
        clamp(F.coalesce(num("confidence"), F.lit(0.5)), 0.0, 1.0).alias("confidence"),
        F.coalesce(num("emotion_intensity").cast("int"), F.lit(3)).alias("emotion_intensity"),
        *[flag(c).alias(c) for c in ("sarcasm", "churn_risk", "fraud_signal", "pii_present")],
        aspects.alias("aspects"), F.coalesce(text("product"), F.lit("unspecified")).alias("product"),
        F.coalesce(text("fraud_type"), F.lit("none")).alias("fraud_type"),
        *[F.coalesce(text(c), F.lit("")).alias(c) for c in
          ("urgency_reason", "root_cause", "recommended_action", "theme", "summary")])
    return record.filter(F.col("source_id").isNotNull())


def merge_depth(baseline: DataFrame, deep: DataFrame, model: str) -> DataFrame:
    """Deep records replace baseline rows; posts without one keep the baseline.

    Personal data counts as present when either the model or the mask saw some.
    """
    values = [c for c in deep.columns if c != "source_id"]
    d = deep.select("source_id", F.struct(*values).alias("_deep"))
    joined = baseline.join(d, "source_id", "left")
    hit = F.col("_deep").isNotNull()
    cols = []
    for c in baseline.columns:
        if c == "pii_present":
            col = F.when(hit, F.greatest(F.col("pii_present"), F.coalesce("_deep.pii_present", F.lit(0)))
                         ).otherwise(F.col(c)) if "pii_present" in values else F.col(c)
        elif c == "model":
            col = F.when(hit, model).otherwise(F.col(c))
        elif c in values:
            col = F.when(hit, F.col(f"_deep.{c}")).otherwise(F.col(c))
        else:
            col = F.col(c)
        cols.append(col.alias(c))
    return joined.select(*cols)


def apply_verdicts(analysis: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Second look: for fraud or critical rows a verdict replaces the fraud flag."""
    v = verdicts.select("source_id", F.col("fraud_signal").alias("_verdict"))
    asked = (F.col("fraud_signal") == 1) | (F.col("urgency") == "critical")
    return analysis.join(v, "source_id", "left").withColumn(
        "fraud_signal", F.when(asked & F.col("_verdict").isNotNull(), F.col("_verdict"))
        .otherwise(F.col("fraud_signal"))).drop("_verdict")
