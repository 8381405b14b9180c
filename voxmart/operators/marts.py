"""Marts over customer mentions. All are partial + final hash aggregations; where a mart
keeps a few rows per key, the ranking runs on pre-aggregated rows or as a limited window
that trims before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmart.config import (BRAND, LEXICON_MODEL, MODEL_PRICES, REACH_SOURCES, THRESHOLDS, TOKENS_IN,
                            TOKENS_OUT, Brand)
from voxmart.functions import labels
from voxmart.functions.labels import count_where, flag_sum, is_negative, needs_follow_up, pct_negative


def _n() -> Column:
    return F.count(F.lit(1))


def _avg(decimals: int | None = 3) -> Column:
    mean = F.avg("score")
    return mean if decimals is None else F.round(mean, decimals)


def _complaints() -> Column:
    return count_where(F.col("intent") == "complaint")


def _most_common(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Modal non-null value per key; of equally frequent values the smallest."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(_n().alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), value))[value].alias(value))


def channel(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Roll-up by source type. Counts per (type, team) come first, so the modal team is picked
    from a handful of rows and the fact table is read once."""
    typed = facts.join(sources.select("source_key", "source_type"), "source_key")
    per_team = typed.groupBy("source_type", "recommended_team").agg(
        _n().alias("n"), F.count_if(is_negative(F.col("sentiment"))).alias("neg"),
        F.sum("score").alias("s"), F.count("score").alias("ns"), _complaints().alias("c"),
        flag_sum("fraud_signal").alias("f"))
    pick = F.min(F.when(F.col("recommended_team") != "none",
                        F.struct((-F.col("n")).alias("n"), "recommended_team")))
    return per_team.groupBy("source_type").agg(
        F.sum("n").alias("mentions"), F.round(F.sum("neg") * 100 / F.sum("n"), 1).alias("pct_negative"),
        F.round(F.sum("s") / F.sum("ns"), 3).alias("avg_score"), F.sum("c").alias("complaints"),
        F.sum("f").alias("fraud_ct"), F.coalesce(pick["recommended_team"], F.lit("none")).alias("top_team"))


def half_split(rows: DataFrame, key: str, at: str, value: str, row_id: str) -> DataFrame:
    """Mean of ``value`` over the older floor(n/2) rows of each key and over the rest.

    The cut is found on per-minute counts; only the rows of the one minute that holds the
    cut are ranked, so a key with a third of all rows is never sorted in one task.
    """
    dated = rows.filter(F.col(at).isNotNull()).withColumn("_minute", F.date_trunc("minute", F.col(at).cast("timestamp")))
    minutes = dated.groupBy(key, "_minute").agg(
        _n().alias("n"), F.sum(value).alias("s"), F.count(value).alias("ns"))
    by_key = Window.partitionBy(key)
    run = minutes.withColumns({
        "_before": F.sum("n").over(by_key.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)),
        "_total": F.sum("n").over(by_key)})
    run = run.withColumns({"_before": F.coalesce("_before", F.lit(0)),
                           "_half": F.floor(F.col("_total") / 2)})
    cut = (F.col("_before") < F.col("_half")) & (F.col("_before") + F.col("n") > F.col("_half"))
    whole = run.filter(~cut).withColumn("_old", F.col("_before") + F.col("n") <= F.col("_half"))
    split = run.filter(cut).select(key, "_minute", (F.col("_half") - F.col("_before")).alias("_take"), "_total")
    ranked = dated.join(split, [key, "_minute"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(key, "_minute").orderBy(at, row_id)))
    partial = ranked.groupBy(key, (F.col("_rn") <= F.col("_take")).alias("_old")).agg(
        F.sum(value).alias("s"), F.count(value).alias("ns"), F.max("_total").alias("_total"))
    both = whole.select(key, "_old", "s", "ns", "_total").unionByName(
        partial.select(key, "_old", "s", "ns", "_total"))

    def mean(side: Column) -> Column:
        return F.sum(F.when(side, F.col("s"))) / F.sum(F.when(side, F.col("ns")))

    return both.groupBy(key).agg(F.max("_total").alias("n_dated"), mean(F.col("_old")).alias("older"),
                                 mean(~F.col("_old")).alias("recent"))


# A product the customer must not hold yet; what must hold of the worst issue (category, team, intent) or of the products
# held; the offer; the line to say.
Offer = tuple[str, dict[str, "str | tuple[str, ...]"], str, str]


def cross_sell(offers: list[Offer], fallback: tuple[str, str], held: Column, category: Column, team: Column,
               intent: Column) -> tuple[Column, Column]:
    """(offer, pitch) by the first offer that fits the customer's products and worst issue."""
    owned = F.transform(F.coalesce(held, F.expr("cast(array() as array<string>)")),
                        lambda p: F.lower(F.trim(p)))
    fields = {"rbi_category": F.coalesce(category, F.lit("not_applicable")),
              "team": F.coalesce(team, F.lit("none")), "intent": F.coalesce(intent, F.lit("other"))}
    offer = pitch = None
    for missing, needs, product, line in offers:
        tests = [~F.array_contains(owned, missing)]
        for name, allowed in needs.items():
            tests.append(F.array_contains(owned, allowed) if name == "held" else fields[name].isin(*allowed))
        hit = reduce(lambda a, b: a & b, tests)
        offer = F.when(hit, product) if offer is None else offer.when(hit, product)
        pitch = F.when(hit, line) if pitch is None else pitch.when(hit, line)
    if offer is None:
        return F.lit(fallback[0]), F.lit(fallback[1])
    return offer.otherwise(fallback[0]), pitch.otherwise(fallback[1])


def rm_enablement(customers: DataFrame, managers: DataFrame, bridge: DataFrame, mentions: DataFrame,
                  interactions: DataFrame, offers: list[Offer], fallback: tuple[str, str]) -> DataFrame:
    """One row per customer: tone, trend, worst issue, offer, last interaction, talking point.

    offers: the house's own list, in the order in which it is tried; fallback: (offer, pitch) where none fits."""
    linked = mentions.join(bridge.select("author", "customer_key"), "author")
    worst = F.min(F.when(is_negative(F.col("sentiment")), F.struct(
        F.col("score").isNull().alias("unscored"), "score", "created_at", "source_id", "root_cause", "summary",
        "rbi_category", "recommended_team", "intent")))
    summary = linked.groupBy("customer_key").agg(
        _n().alias("n"), F.avg("score").alias("mean"),
        F.count_if(is_negative(F.col("sentiment"))).alias("open_issues"), worst.alias("w"),
        F.max(F.coalesce("churn_risk", F.lit(0))).alias("churn_flag"),
        F.max(F.coalesce("fraud_signal", F.lit(0))).alias("fraud_flag"))
    trend = half_split(linked, "customer_key", "created_at", "score", "source_id")
    last = interactions.filter(F.col("customer_key").isNotNull()).groupBy("customer_key").agg(
        F.max(F.struct("opened_at", "issue_id", "resolved", "customer_satisfied", "first_response_at")).alias("i"))
    out = (customers.join(managers.select("rm_id", "rm_name"), "rm_id", "left")
           .join(summary, "customer_key", "left").join(trend, "customer_key", "left")
           .join(last, "customer_key", "left"))
    has_issue = F.col("w").isNotNull()
    text_of = lambda c: F.when(F.col(c) != "", F.col(c))
    pain = F.when(has_issue, F.coalesce(text_of("w.root_cause"), text_of("w.summary"), F.lit("(see mention)"))
                  ).otherwise("No negative mentions on record")
    area = F.when(has_issue, F.when(F.coalesce("w.rbi_category", F.lit("not_applicable")) != "not_applicable",
                                    F.col("w.rbi_category")).otherwise(F.col("w.recommended_team"))
                  ).otherwise("none")
    offer, pitch = cross_sell(
        offers, fallback,
        F.col("products_held"), F.when(has_issue, F.col("w.rbi_category")),
        F.when(has_issue, F.col("w.recommended_team")), F.when(has_issue, F.col("w.intent")))
    cut = THRESHOLDS.trend_cut
    moved = F.when((F.col("n_dated") >= 2) & (F.col("recent") > F.col("older") + cut), "improving").when(
        (F.col("n_dated") >= 2) & (F.col("recent") < F.col("older") - cut), "worsening").otherwise("flat")
    outcome = (F.when(F.col("i").isNull(), "no public interaction")
               .when((F.col("i.resolved") == 1) & (F.coalesce("i.customer_satisfied", F.lit(0)) == 1),
                     "resolved · satisfied")
               .when(F.col("i.resolved") == 1, "resolved")
               .when(F.col("i.first_response_at").isNull(), "awaiting response").otherwise("in progress"))
    out = out.withColumns({"top_pain_point": pain, "top_pain_area": area, "cross_sell_product": offer,
                           "cross_sell_pitch": pitch})
    return out.select(
        "customer_key", "customer_name", "rm_id", F.coalesce("rm_name", F.lit("")).alias("rm_name"), "segment",
        "products_held", labels.stance(F.col("mean")).alias("current_sentiment"),
        moved.alias("sentiment_trend"), "top_pain_point", "top_pain_area",
        F.coalesce("open_issues", F.lit(0)).alias("open_issues"),
        F.coalesce("churn_flag", F.lit(0)).alias("churn_flag"),
        F.coalesce("fraud_flag", F.lit(0)).alias("fraud_flag"), "cross_sell_product", "cross_sell_pitch",
        outcome.alias("last_interaction_outcome"),
        F.concat(F.lit("Lead with the "), F.coalesce("top_pain_area", F.lit("none")), F.lit(" issue ("),
                 "top_pain_point", F.lit("); once acknowledged, pitch "), "cross_sell_product",
                 F.lit(".")).alias("talking_point"))


def follow_up_status(facts: DataFrame, interactions: DataFrame) -> DataFrame:
    """Add ``followup`` and the thread's latency: none needed, resolved, answered, open or pending."""
    issues = interactions.select(F.col("inbound_source_id").alias("source_id"), F.col("resolved").alias("_res"),
                                 F.col("first_response_at").isNotNull().alias("_ans"), "response_latency_min")
    status = (F.when(~needs_follow_up(F.col("intent"), F.col("urgency")), "no_followup")
              .when(F.col("_res") == 1, "resolved").when(F.col("_ans"), "in_progress")
              .when(F.col("_res").isNotNull(), "unresolved").otherwise("pending"))
    return facts.join(issues, "source_id", "left").withColumn("followup", status).drop("_res", "_ans")


STATUSES = ("no_followup", "pending", "in_progress", "resolved", "unresolved")


def admin_analytics(facts: DataFrame, interactions: DataFrame) -> DataFrame:
    """Category x team: mentions per follow-up status, negativity, mean latency."""
    rows = follow_up_status(facts, interactions)
    return rows.groupBy(F.coalesce("rbi_category", F.lit("not_applicable")).alias("category"),
                        F.coalesce("recommended_team", F.lit("none")).alias("team")).agg(
        _n().alias("mentions"), pct_negative().alias("pct_negative"),
        *[F.count_if(F.col("followup") == s).alias(s) for s in STATUSES],
        F.round(F.avg("response_latency_min"), 1).alias("avg_response_latency_min"))


def status_long(admin: DataFrame) -> DataFrame:
    """The status columns as rows, without the zeros and without ``no_followup``."""
    return admin.unpivot(["category", "team"], ["pending", "in_progress", "resolved", "unresolved"],
                         "status", "items").filter(F.col("items") > 0)


def kpis(facts: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row: volume, negativity, follow-ups, resolved, recovery rate, median latency.

    The median is read off a histogram of latencies (tenths of minutes), which combines
    map-side, instead of gathering every latency in one buffer.
    """
    left = facts.agg(_n().alias("total_mentions"), pct_negative().alias("pct_negative"),
                     F.count_if(needs_follow_up(F.col("intent"), F.col("urgency"))).alias("needs_followup"))
    answered = F.col("first_response_at").isNotNull()
    recovered = answered & ((F.coalesce("customer_satisfied", F.lit(0)) == 1)
                            | (F.coalesce("recovery_delta", F.lit(0.0)) > 0))
    right = (interactions.groupBy(F.when(answered, F.col("response_latency_min")).alias("lat"))
             .agg(_n().alias("n"), F.count_if(F.col("resolved") == 1).alias("res"),
                  F.count_if(answered).alias("ans"), F.count_if(recovered).alias("rec"))
             .agg(F.coalesce(F.sum("res"), F.lit(0)).alias("resolved_count"),
                  F.coalesce(F.round(F.sum("rec") * 100 / F.nullif(F.sum("ans"), F.lit(0)), 1), F.lit(0.0))
                  .alias("sentiment_recovery_rate"),
                  F.round(F.percentile("lat", 0.5, F.col("n")), 1).alias("median_response_latency_min")))
    # Two one-row results side by side, without a join.
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.agg(F.lit(1).alias("id"), *[F.max(c).alias(c) for c in (
        "total_mentions", "pct_negative", "needs_followup", "resolved_count", "sentiment_recovery_rate",
        "median_response_latency_min")])


def product_scorecard(rows: DataFrame) -> DataFrame:
    named = rows.filter(F.lower(F.coalesce("product", F.lit("unspecified"))) != "unspecified")
    pos = F.count_if(F.col("sentiment") == "positive")
    neg = F.count_if(is_negative(F.col("sentiment")))
    return named.groupBy("product").agg(
        _n().alias("mentions"), pct_negative().alias("pct_negative"), _complaints().alias("complaints"),
        _avg().alias("avg_score"), F.round((pos - neg) * 100 / _n(), 1).alias("nps_proxy"))


# Filler product labels, and ordered patterns -> canonical product.
PRODUCT_FILLER = ("none", "other", "general", "banking", "banking services", "unspecified", "bank", "n/a", "")
PRODUCT_PATTERNS = (
    (r"credit\s*_?card|\bcc\b", "Credit card"), (r"debit\s*_?card", "Debit card"),
    (r"mobile|\bapp\b", "Mobile app"),
    (r"net\s*_?banking|internet\s*_?banking|online\s*banking", "Internet banking"),
    (r"upi|payment", "UPI & payments"), (r"loan|emi|mortgage", "Loans"),
    (r"fixed\s*deposit|\bfd\b|deposit", "Deposits"), (r"account|savings|salary", "Accounts"),
    (r"branch|atm", "Branch & ATM"), (r"insurance|max\s*life", "Insurance"),
    (r"forex|remit", "Forex & remittance"), (r"support|service|care|grievance", "Customer service"))


def canonical_product(raw: Column, brand: Brand = BRAND) -> Column:
    """Free-text product -> governed name; fillers and unknown names -> NULL."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    chain = F.when(low.isin(*PRODUCT_FILLER, brand.name.lower()), F.lit(None).cast("string"))
    for pattern, name in PRODUCT_PATTERNS:
        chain = chain.when(low.rlike(f"(?U){pattern}"), name)
    return chain


def normalise_products(scorecard: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Scorecard rows of one product merged; rates are re-derived from counts, not averaged."""
    named = scorecard.withColumn("canonical", canonical_product(F.col("product"), brand)).filter(
        F.col("canonical").isNotNull())
    weight = F.sum("mentions")
    return named.groupBy("canonical").agg(
        weight.alias("mentions"), F.sum("complaints").alias("complaints"),
        (F.sum(F.col("pct_negative") * F.col("mentions")) / weight).alias("pct_negative"),
        (F.sum(F.col("avg_score") * F.col("mentions")) / weight).alias("avg_score"))


def influencers(rows: DataFrame, top: int = 25) -> DataFrame:
    """Widest-reaching authors with stance and their worst post."""
    reach = F.greatest(F.coalesce("engagement", F.lit(0)), F.coalesce("view_count", F.lit(0)))
    named = F.when(F.col("author_name").isNotNull(), F.struct("created_at", "source_id"))
    board = rows.filter(F.coalesce("author", F.lit("")) != "").groupBy("author").agg(
        F.max(F.struct(named.alias("at"), "author_name")).alias("named"), F.max(reach).alias("reach"),
        _n().alias("mentions"), F.avg("score").alias("mean"),
        F.min(F.struct(F.col("score").isNull().alias("unscored"), "score", "created_at", "source_id",
                       "summary", "url")).alias("w"))
    return (board.select("author", F.coalesce("named.author_name", "author").alias("author_name"), "reach",
                         "mentions", F.round("mean", 3).alias("avg_score"),
                         labels.stance(F.col("mean")).alias("stance"),
                         F.coalesce("w.summary", F.lit("")).alias("worst_summary"),
                         F.col("w.url").alias("url"))
            .orderBy(F.desc("reach"), "author").limit(top))


def influencer_flags(board: DataFrame) -> DataFrame:
    """CHECK where the average reads positive while there is a worst post to read."""
    hidden = (F.col("stance") == "positive") & (F.trim(F.coalesce("worst_summary", F.lit(""))) != "")
    return board.withColumn("flag", F.when(hidden, "CHECK").otherwise(""))


def team_queue(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("recommended_team", F.lit("none")).alias("team")).agg(
        F.count_if(needs_follow_up(F.col("intent"), F.col("urgency"))).alias("open_items"),
        count_where(F.col("urgency") == "critical").alias("critical"), flag_sum("fraud_signal").alias("fraud"),
        _avg().alias("avg_score"))


def fraud_board(rows: DataFrame, handles: int = 5) -> DataFrame:
    """Fraud posts by type with the first few distinct handles and the first link."""
    typed = rows.filter(F.col("fraud_signal") == 1).withColumn(
        "fraud_type", F.coalesce("fraud_type", F.lit("suspected")))
    first = F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "source_id")
    per_author = typed.groupBy("fraud_type", "author").agg(
        F.min(first).alias("at"), _n().alias("n"), F.sum("score").alias("s"), F.count("score").alias("ns"),
        F.min(F.when(F.col("url").isNotNull(), F.struct(first.alias("at"), "url"))).alias("link"))
    rank = F.row_number().over(Window.partitionBy("fraud_type").orderBy("at", "author"))
    chosen = (per_author.filter(F.coalesce("author", F.lit("")) != "").withColumn("rn", rank)
              .filter(F.col("rn") <= handles).groupBy("fraud_type")
              .agg(F.array_sort(F.collect_list(F.struct("rn", "author"))).alias("h")))
    totals = per_author.groupBy("fraud_type").agg(
        F.sum("n").alias("cnt"), F.min("link").alias("link"),
        F.round(F.sum("s") / F.sum("ns"), 3).alias("avg_score"))
    return totals.join(chosen, "fraud_type", "left").select(
        "fraud_type", "cnt",
        F.coalesce(F.array_join(F.transform("h", lambda x: x["author"]), ", "), F.lit("")).alias("sample_handles"),
        F.coalesce("link.url", F.lit("")).alias("sample_url"), "avg_score")


def geo(rows: DataFrame) -> DataFrame:
    """City x region. Expects ``city`` and ``region`` from the keyword inference."""
    return rows.filter(F.col("city").isNotNull()).groupBy("city", "region").agg(
        _n().alias("mentions"), pct_negative().alias("pct_negative"), _avg().alias("avg_score"))


def geo_rollup(rows: DataFrame) -> DataFrame:
    """Cities with a subtotal per region and a grand total in one pass."""
    return rows.filter(F.col("city").isNotNull()).rollup("region", "city").agg(
        _n().alias("mentions"), pct_negative().alias("pct_negative"), F.grouping_id().alias("level"))


def region_summary(cities: DataFrame) -> DataFrame:
    return cities.groupBy("region").agg(F.sum("mentions").alias("mentions"), F.avg("avg_score").alias("avg"))


def share_of_voice(own: DataFrame, competitors: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Own brand against competitors. Whether own accounts count is the caller's choice of ``own``."""
    both = own.select(F.lit(brand.name).alias("brand"), "sentiment", "score").unionByName(
        competitors.select("brand", "sentiment", "score"))
    per_brand = both.filter(F.col("brand").isNotNull()).groupBy("brand").agg(
        _n().alias("mentions"), pct_negative().alias("pct_negative"), _avg().alias("avg_score"))
    # The window runs over one row per brand.
    total = F.sum("mentions").over(Window.partitionBy())
    return per_brand.withColumn("share_of_voice", F.round(F.col("mentions") * 100 / total, 1))


def entities(tagged: DataFrame) -> DataFrame:
    """Expects the array ``entities`` of (entity, etype) per post."""
    return tagged.select("score", F.explode("entities").alias("e")).groupBy(
        F.col("e.entity").alias("entity"), F.col("e.etype").alias("etype")).agg(
        _n().alias("mentions"), _avg().alias("avg_score"))


def headline_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(
        _n().alias("mentions"), _avg().alias("net_sentiment"), pct_negative().alias("pct_negative"),
        F.count_if(is_negative(F.col("sentiment"))).alias("negative"), _complaints().alias("complaints"),
        count_where(F.col("urgency") == "critical").alias("critical"),
        flag_sum("fraud_signal").alias("fraud_flags"), flag_sum("churn_risk").alias("churn_flags"))


def preset_counts(rows: DataFrame, columns=("source", "sentiment", "urgency")) -> DataFrame:
    """(facet, value, n) for several columns from one scan, by grouping sets."""
    sets = [[F.col(c)] for c in columns]
    grouped = rows.groupingSets(sets, *columns).agg(_n().alias("n"), F.grouping_id(*columns).alias("_g"))
    width = len(columns)
    facet = value = None
    for i, c in enumerate(columns):
        here = F.col("_g") == (2 ** width - 1) - 2 ** (width - 1 - i)
        facet = F.when(here, c) if facet is None else facet.when(here, c)
        value = F.when(here, F.col(c)) if value is None else value.when(here, F.col(c))
    return grouped.select(facet.alias("facet"), value.alias("value"), "n")


# Index weights, ceilings at which a component scores zero, grade cuts.
INDEX_WEIGHTS = (("sentiment_balance", 0.35), ("complaint_load", 0.25), ("issue_severity", 0.20),
                 ("trust_safety", 0.20))
INDEX_CEILINGS = {"complaint_load": 0.40, "issue_severity": 0.25, "trust_safety": 0.10}
GRADES = ((80, "Strong"), (65, "Healthy"), (50, "Watch"), (35, "Strained"))


def performance_index(rows: DataFrame) -> DataFrame:
    """Four components of 0-100, their weighted sum and its grade, from one aggregation."""
    base = rows.agg(
        F.greatest(_n(), F.lit(1)).alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("net"),
        _complaints().alias("complaint_load"),
        count_where(F.col("urgency").isin("critical", "high")).alias("issue_severity"),
        count_where(F.col("intent").isin("fraud_report", "churn_threat", "legal_threat")).alias("trust_safety"))
    parts = {"sentiment_balance": (F.col("net") + 1) / 2 * 100}
    for name, ceiling in INDEX_CEILINGS.items():
        parts[name] = F.greatest(F.lit(0.0), 1 - F.col(name) / F.col("n") / ceiling) * 100
    out = base.select(*[v.alias(k) for k, v in parts.items()])
    out = out.withColumn("index_score", reduce(lambda a, b: a + b, [F.col(k) * w for k, w in INDEX_WEIGHTS]))
    grade = reduce(lambda c, g: c.when(F.col("index_score") >= g[0], g[1]), GRADES[1:],
                   F.when(F.col("index_score") >= GRADES[0][0], GRADES[0][1]))
    return out.withColumn("grade", grade.otherwise("Critical"))


def period_deltas(daily: DataFrame, days: int = 30) -> DataFrame:
    """The newest ``days`` days and the same span before, anchored on the newest day."""
    d = daily.withColumn("day", F.to_date(F.col("date_key").cast("string"), "yyyyMMdd"))
    age = F.datediff(F.max("day").over(Window.partitionBy()), "day")
    # The unpartitioned window sees one row per day.
    per_day = d.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("mentions", "negatives", "complaints", "fraud_ct")])
    period = F.when(F.col("age") < days, "current").when(F.col("age") < 2 * days, "previous")
    return (per_day.withColumn("age", age).withColumn("period", period).filter(F.col("period").isNotNull())
            .groupBy("period").agg(
                F.sum("mentions").alias("mentions"),
                (F.sum("negatives") * 100 / F.sum("mentions")).alias("neg_rate"),
                F.sum("complaints").alias("complaints"), F.sum("fraud_ct").alias("fraud")))


def aspect_pivot(aspect_counts: DataFrame, top: int = 9) -> DataFrame:
    """Aspect x tone counts without the catch-all, largest totals first."""
    tones = ("negative", "neutral", "positive", "mixed")
    wide = (aspect_counts.filter(F.col("aspect").isNotNull() & (F.col("aspect") != "other"))
            .groupBy("aspect").pivot("sentiment", list(tones)).agg(F.sum("n")))
    wide = wide.select("aspect", *[F.coalesce(t, F.lit(0)).alias(t) for t in tones])
    return (wide.withColumn("tot", reduce(lambda a, b: a + b, [F.col(t) for t in tones]))
            .orderBy(F.desc("tot"), "aspect").limit(top))


def category_comparison(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("issue_category", F.lit("other")).alias("issue_category")).agg(
        _n().alias("posts"), _avg(None).alias("avg_score"),
        count_where(F.col("urgency") == "critical").alias("critical"), flag_sum("fraud_signal").alias("fraud"))


def thread_summary(rows: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Conversations of several posts: size, voices, tone, and pile-on or one account."""
    threads = rows.filter(F.coalesce("conversation_id", F.lit("")) != "").groupBy("conversation_id").agg(
        _n().alias("posts"), F.count_distinct("author").alias("authors"), _avg(None).alias("avg_score"),
        F.min("score").alias("worst")).filter(F.col("posts") > 1)
    pile_on = F.col("authors") >= F.col("posts") * 0.7
    out = threads.withColumn("kind", F.when(pile_on, "mass outrage").otherwise("single-actor repetition"))
    if answered is None:
        return out
    replied = answered.filter(F.col("n_bank_replies") > 0).select("conversation_id", F.lit(True).alias("bank_replied"))
    return out.join(replied, "conversation_id", "left").withColumn(
        "bank_replied", F.coalesce("bank_replied", F.lit(False)))


def source_coverage(posts: DataFrame, analysis: DataFrame) -> DataFrame:
    scored = analysis.select("source_id", "score", F.lit(1).alias("_hit"))
    return posts.select("source_id", "source").join(scored, "source_id", "left").groupBy("source").agg(
        _n().alias("collected"), F.count("_hit").alias("classified"),
        (_n() - F.count("_hit")).alias("unclassified"), _avg().alias("avg_sentiment"))


def model_depth(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(_n().alias("posts"), F.round(F.avg("confidence"), 3).alias("avg_confidence"),
                                     F.count_distinct("emotion").alias("distinct_emotions"))


def intent_profile(rows: DataFrame) -> DataFrame:
    return rows.groupBy("intent").agg(
        _n().alias("posts"), _avg().alias("avg_score"), flag_sum("fraud_signal").alias("fraud_flags"),
        count_where(F.col("urgency") == "critical").alias("critical"))


def category_daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.to_date("created_at").alias("day"),
                        F.coalesce("rbi_category", F.lit("not_applicable")).alias("category")).agg(
        _n().alias("mentions"), _avg().alias("avg_score"),
        F.round(F.count_if(is_negative(F.col("sentiment"))) / _n(), 3).alias("neg_ratio"))


def team_load(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("recommended_team", F.lit("none")).alias("team")).agg(
        _n().alias("items"), count_where(F.col("urgency").isin("high", "critical")).alias("urgent"),
        flag_sum("fraud_signal").alias("fraud"))


def daily_tone(rows: DataFrame) -> DataFrame:
    """Dated posts per day and tone."""
    return rows.filter(F.col("created_at").isNotNull()).groupBy(
        F.to_date("created_at").alias("day"), "sentiment").agg(_n().alias("n"))


def quality_snapshot(rows: DataFrame) -> DataFrame:
    """(metric, value): share read by a model, mean confidence, share of confident rows."""
    conf = F.coalesce("confidence", F.lit(0.0))
    one = rows.agg(
        F.round(count_where(F.col("model") != LEXICON_MODEL) * 100 / _n(), 2).alias("deep"),
        F.round(F.avg(conf), 3).alias("mean"), F.round(F.count_if(conf >= 0.5) * 100 / _n(), 2).alias("high"))
    return one.select(F.expr("stack(3, 'deep_coverage_pct', deep, 'avg_confidence', mean, 'high_conf_pct', high)"
                             " as (metric, value)"))


def drift_flags(history: DataFrame) -> DataFrame:
    """Metrics whose last snapshot fell by more than the allowed share of the one before."""
    w = Window.partitionBy("metric").orderBy("run_ts")
    newest = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("run_ts")))
    drop = (F.col("prev") - F.col("value")) / F.abs("prev")
    return (history.withColumns({"prev": F.lag("value").over(w), "_back": newest})
            .filter((F.col("_back") == 1) & (F.col("prev") != 0) & (drop > THRESHOLDS.drift_drop))
            .select("metric", "prev", F.col("value").alias("cur")))


def cost_estimate(rows: DataFrame, prices=MODEL_PRICES) -> DataFrame:
    """Calls, tokens and money per run; the lexicon costs nothing, unknown models are free."""
    calls = rows.groupBy("model").agg(_n().alias("n"))
    price_in = labels.lookup(F.col("model"), {m: i for m, i, _ in prices}, 0.0)
    price_out = labels.lookup(F.col("model"), {m: o for m, _, o in prices}, 0.0)
    paid = F.when(F.col("model").eqNullSafe(F.lit(LEXICON_MODEL)), 0).otherwise(F.col("n"))
    cost = paid * TOKENS_IN / 1e6 * price_in + paid * TOKENS_OUT / 1e6 * price_out
    return calls.agg(F.sum("n").alias("mentions"), F.sum(paid).alias("model_calls"),
                     F.sum(paid * (TOKENS_IN + TOKENS_OUT)).alias("tokens_est"),
                     F.round(F.sum(cost), 4).alias("cost_usd_est"))


def customer_timeline(rows: DataFrame, bridge: DataFrame, interactions: DataFrame) -> DataFrame:
    """Mentions and thread outcomes of linked customers as one list of dated events."""
    posts = rows.join(bridge.select("author", "customer_key"), "author").select(
        "customer_key", F.lit("mention").alias("event"), F.col("source_id").alias("ref"),
        F.col("created_at").alias("at"), "sentiment", "score", F.col("intent").alias("detail"))
    threads = interactions.filter(F.col("customer_key").isNotNull()).select(
        "customer_key", F.lit("interaction").alias("event"), F.col("issue_id").alias("ref"),
        F.col("opened_at").alias("at"), F.lit(None).cast("string").alias("sentiment"),
        F.col("inbound_score").alias("score"), F.col("resolution_type").alias("detail"))
    return posts.unionByName(threads)


def customer_summary(timeline: DataFrame) -> DataFrame:
    mention = F.col("event") == "mention"
    return timeline.groupBy("customer_key").agg(
        F.count_if(mention).alias("mentions"), F.count_if(~mention).alias("interactions"),
        F.avg(F.when(mention, F.coalesce("score", F.lit(0.0)))).alias("avg_score"))


def root_causes(rows: DataFrame) -> DataFrame:
    """Per cluster the modal root cause, action and owner; empty labels do not vote."""
    base = rows.filter(F.col("cluster_id").isNotNull())
    out = base.groupBy("cluster_id").agg(_n().alias("posts"))
    for column in ("root_cause", "recommended_action", "recommended_team"):
        votes = base.withColumn(column, F.when(F.col(column) != "", F.col(column)))
        out = out.join(_most_common(votes, "cluster_id", column), "cluster_id", "left")
    return out


def worst_per_cluster(rows: DataFrame, top: int = 25) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.asc_nulls_last("score"), "source_id"))
    return rows.filter(F.col("cluster_id").isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= top)


def anomaly_feed(trends: DataFrame) -> DataFrame:
    return trends.filter(F.col("anomaly") == 1).orderBy(F.desc(F.abs("z_score")), "category", "day")


def channel_daily(daily_view: DataFrame, days: int = 30) -> DataFrame:
    """Mentions per source type over the newest ``days`` days that have data."""
    agg = daily_view.filter(F.col("full_date").isNotNull()).groupBy("full_date", "source_type").agg(
        F.sum("mentions").alias("mentions"))
    recent = agg.select("full_date").distinct().orderBy(F.desc("full_date")).limit(days)
    return agg.join(recent, "full_date", "left_semi")


def highlights(rows: DataFrame, reach_sources=REACH_SOURCES) -> DataFrame:
    """Most reshared, viewed and replied posts (zero does not rank), best and worst score."""
    def best(metric: str, sign: int, only: Column) -> Column:
        order = F.struct((F.col(metric) * sign).alias("v"), "source_id", F.col(metric).alias("metric"))
        return F.min(F.when(only & F.col(metric).isNotNull(), order))

    reach = F.col("source").isin(*reach_sources)
    picks = (("most_reshared", best("retweet_count", -1, reach & (F.col("retweet_count") != 0))),
             ("most_viewed", best("view_count", -1, reach & (F.col("view_count") != 0))),
             ("most_replied", best("reply_count", -1, reach & (F.col("reply_count") != 0))),
             ("top_positive", best("score", -1, F.lit(True))),
             ("top_negative", best("score", 1, F.lit(True))))
    one = rows.agg(*[p.alias(n) for n, p in picks])
    tiles = F.array(*[F.struct(F.lit(n).alias("tile"), F.col(n)["source_id"].alias("source_id"),
                               F.col(n)["metric"].cast("double").alias("metric")) for n, _ in picks])
    return one.select(F.inline(tiles)).filter(F.col("source_id").isNotNull())


# ---------------------------------------------------------------- briefs
def brief_lines(rows: DataFrame, aspects: DataFrame, clusters: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """(section, rank, line): the executive brief as rows, ready to be joined into text."""
    head = headline_kpis(rows).select(
        F.lit("headline").alias("section"), F.lit(1).alias("rank"),
        F.format_string("%d mentions analysed, %s%% negative, %d complaints, %d critical, %d fraud, %d churn-risk",
                        "mentions", F.col("pct_negative").cast("string"), "complaints", "critical",
                        "fraud_flags", "churn_flags").alias("line"))
    ranked = Window.partitionBy("section").orderBy(F.desc("n"), "key")
    by_aspect = aspects.filter(is_negative(F.col("sentiment")) & F.col("aspect").isNotNull()).groupBy(
        F.lit("aspects").alias("section"), F.col("aspect").alias("key")).agg(_n().alias("n"))
    issues = clusters.select(F.lit("issues").alias("section"), F.col("title").alias("key"),
                             F.col("size").alias("n"), "avg_score", "top_team", "recent_share")
    asp = (by_aspect.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= 8)
           .select("section", "rank", F.format_string("%s (%d)", "key", "n").alias("line")))
    emerging = (F.col("recent_share") >= THRESHOLDS.emerging_share) & (F.col("avg_score") < 0)
    iss = (issues.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= 8)
           .select("section", "rank", F.concat(
               F.format_string("%s: %d mentions, avg %s, owner %s", "key", "n",
                               F.col("avg_score").cast("string"), "top_team"),
               F.when(emerging, ", emerging").otherwise("")).alias("line")))
    worst = (rows.filter(F.col("score") < 0)
             .orderBy("score", F.desc(labels.urgency_rank(F.col("urgency"))), "source_id").limit(12)
             .select(F.lit("worst").alias("section"),
                     F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(
                         "score", F.desc(labels.urgency_rank(F.col("urgency"))), "source_id")).alias("rank"),
                     F.format_string("[%s] %s (%s)", "urgency", "summary", "recommended_team").alias("line")))
    return head.unionByName(asp).unionByName(iss).unionByName(worst)


def weekly_digest(kpi: DataFrame, sov: DataFrame, clusters: DataFrame) -> DataFrame:
    """(section, rank, line): KPI line, share of voice, five largest issues."""
    top = kpi.select(F.lit("kpis").alias("section"), F.lit(1).alias("rank"), F.format_string(
        "%d mentions, %s%% negative, sentiment recovery %s%%, %d need follow-up", "total_mentions",
        F.col("pct_negative").cast("string"), F.col("sentiment_recovery_rate").cast("string"),
        "needs_followup").alias("line"))
    by_volume = Window.partitionBy("section").orderBy(F.desc("n"), "key")
    voice = sov.select(F.lit("share_of_voice").alias("section"), F.col("brand").alias("key"),
                       F.col("mentions").alias("n"), F.format_string(
        "%s: %d mentions (%s%% of voice), avg %s", "brand", "mentions",
        F.col("share_of_voice").cast("string"), F.col("avg_score").cast("string")).alias("line"))
    issues = clusters.select(F.lit("issues").alias("section"), F.col("title").alias("key"),
                             F.col("size").alias("n"), F.format_string(
        "%s: %d mentions (owner %s)", "title", "size", "top_team").alias("line")).orderBy(F.desc("n"), "key").limit(5)
    ranked = voice.unionByName(issues).withColumn("rank", F.row_number().over(by_volume))  # brands, and five issues
    return top.unionByName(ranked.select("section", "rank", "line"))


# ---------------------------------------------------------------- label evaluation
def confusion(gold: DataFrame, predicted: DataFrame, key: str, fields) -> DataFrame:
    """(field, gold, predicted, n) over the rows both sides have."""
    pair = gold.alias("g").join(predicted.alias("p"), key)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g.{f}").cast("string").alias("gold"),
                               F.col(f"p.{f}").cast("string").alias("predicted")) for f in fields])
    return pair.select(F.inline(cells)).groupBy("field", "gold", "predicted").agg(_n().alias("n"))


def accuracy(cells: DataFrame) -> DataFrame:
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    return cells.groupBy("field").agg(F.sum("n").alias("rows"), (F.sum(hit) / F.sum("n")).alias("accuracy"))


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; a class never seen on one side scores 0."""
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    # Each cell votes for its gold class and for its predicted class.
    votes = cells.select("field", F.inline(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 hit.cast("bigint").alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hits")))))
    sums = votes.groupBy("field", "label").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hits")])
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sums.select(
        "field", "label", "support", div(F.col("hits"), F.col("guessed")).alias("precision"),
        div(F.col("hits"), F.col("support")).alias("recall"),
        div(F.col("hits") * 2, F.col("guessed") + F.col("support")).alias("f1"))


def disagreements(gold: DataFrame, predicted: DataFrame, key: str, fields) -> DataFrame:
    pair = gold.alias("g").join(predicted.alias("p"), key)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g.{f}").cast("string").alias("gold"),
                               F.col(f"p.{f}").cast("string").alias("predicted")) for f in fields])
    return pair.select(key, F.inline(cells)).filter(F.col("gold") != F.col("predicted"))
