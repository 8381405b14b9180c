"""Marts, series and briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmart import adapters as A
from voxmart.adapters import with_ctes
from voxmart.operators import churn, dims, facts, issues, marts, series, worklists
from voxmart.plans.catalog_facts import (DAILY, FACTS, FOLLOW, INTERACTIONS, NEG, SOURCES, base, daily, fact_rows,
                                         interactions, thread_bridge, with_aspects)
from voxmart.plans.registry import query

MENTIONS = with_ctes("mentions")
PCT = f"round(100 * count(*) FILTER ({NEG}) / count(*), 1)"


@query("mart_channel", with_ctes("mentions", "bridge") + f""", {FACTS}, {SOURCES},
typed AS (SELECT * FROM facts JOIN sources USING (source_key)),
top AS (SELECT source_type, recommended_team AS top_team FROM (SELECT source_type, recommended_team, row_number() OVER (
  PARTITION BY source_type ORDER BY count(*) DESC, recommended_team) AS rn FROM typed WHERE recommended_team <> 'none'
  GROUP BY source_type, recommended_team) WHERE rn = 1)
SELECT source_type, count(*) AS mentions, {PCT} AS pct_negative, round(avg(score), 3) AS avg_score,
  count(*) FILTER (intent = 'complaint') AS complaints, CAST(sum(fraud_signal) AS BIGINT) AS fraud_ct,
  coalesce(any_value(top_team), 'none') AS top_team FROM typed LEFT JOIN top USING (source_type) GROUP BY source_type""")
def _(spark, sf):
    return marts.channel(fact_rows(spark, sf), dims.dim_source(spark))


# Threads stand in for mentions where an interaction has to meet the mention it is about.
STATUS = f"""st AS (SELECT m.*, CASE WHEN NOT {FOLLOW} THEN 'no_followup' WHEN i.resolved = 1 THEN 'resolved'
  WHEN i.first_response_at IS NOT NULL THEN 'in_progress' WHEN i.resolved IS NOT NULL THEN 'unresolved'
  ELSE 'pending' END AS followup, i.response_latency_min FROM tm m LEFT JOIN interactions i
  ON m.source_id = i.inbound_source_id)"""
THREAD_MENTIONS = f"""tm AS (SELECT *, CASE WHEN score < -0.25 THEN 'complaint' WHEN score = 0 THEN 'query' ELSE 'praise'
  END AS intent, CASE WHEN score < -0.4 THEN 'critical' ELSE 'low' END AS urgency,
  CASE length(text) % 3 WHEN 0 THEN 'upi' WHEN 1 THEN 'credit_card' END AS rbi_category,
  CASE length(text) % 2 WHEN 0 THEN 'cards' END AS recommended_team,
  CASE WHEN score < -0.3 THEN 1 ELSE 0 END AS fraud_signal FROM t WHERE NOT own)"""


def thread_mentions(spark, sf):
    n = F.length("text")
    rows = facts.customer_voice(A.threads(spark, sf))
    return rows.withColumns({
        "intent": F.when(F.col("score") < -0.25, "complaint").when(F.col("score") == 0, "query").otherwise("praise"),
        "urgency": F.when(F.col("score") < -0.4, "critical").otherwise("low"),
        "rbi_category": F.when(n % 3 == 0, "upi").when(n % 3 == 1, "credit_card"),
        "recommended_team": F.when(n % 2 == 0, "cards"),
        "fraud_signal": F.when(F.col("score") < -0.3, 1).otherwise(0)})


@query("mart_admin_analytics", with_ctes("threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS}, {STATUS}
SELECT coalesce(rbi_category, 'not_applicable') AS category, coalesce(recommended_team, 'none') AS team,
  count(*) AS mentions, {PCT} AS pct_negative, count(*) FILTER (followup = 'no_followup') AS no_followup,
  count(*) FILTER (followup = 'pending') AS pending, count(*) FILTER (followup = 'in_progress') AS in_progress,
  count(*) FILTER (followup = 'resolved') AS resolved, count(*) FILTER (followup = 'unresolved') AS unresolved,
  round(avg(response_latency_min), 1) AS avg_response_latency_min FROM st GROUP BY ALL""")
def _(spark, sf):
    return marts.admin_analytics(thread_mentions(spark, sf), interactions(spark, sf))


@query("followup_status", with_ctes("threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS}, {STATUS}
SELECT source_id, followup, response_latency_min FROM st""")
def _(spark, sf):
    return marts.follow_up_status(thread_mentions(spark, sf), interactions(spark, sf)).select(
        "source_id", "followup", "response_latency_min")


@query("followup_status_long", with_ctes("threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS}, {STATUS}
SELECT coalesce(rbi_category, 'not_applicable') AS category, coalesce(recommended_team, 'none') AS team,
  followup AS status, count(*) AS items FROM st WHERE followup <> 'no_followup' GROUP BY ALL""")
def _(spark, sf):
    return marts.status_long(marts.admin_analytics(thread_mentions(spark, sf), interactions(spark, sf)))


KPIS = f"""kpis AS (SELECT 1 AS id, (SELECT count(*) FROM tm) AS total_mentions, (SELECT {PCT} FROM tm) AS pct_negative,
  (SELECT count(*) FILTER ({FOLLOW}) FROM tm) AS needs_followup, count(*) FILTER (resolved = 1) AS resolved_count,
  round(100 * count(*) FILTER (first_response_at IS NOT NULL AND (customer_satisfied = 1 OR recovery_delta > 0))
    / count(first_response_at), 1) AS sentiment_recovery_rate,
  round(median(response_latency_min), 1) AS median_response_latency_min FROM interactions)"""


@query("mart_kpis", with_ctes("threads") + f", {INTERACTIONS}, {THREAD_MENTIONS}, {KPIS} SELECT * FROM kpis")
def _(spark, sf):
    return marts.kpis(thread_mentions(spark, sf), interactions(spark, sf))


RM = """
  lm AS (SELECT m.*, b.customer_key FROM mentions m JOIN bridge b USING (author)),
  s AS (SELECT customer_key, avg(score) AS mean, count(*) FILTER (sentiment IN ('negative', 'mixed')) AS open_issues,
    max(churn_risk) AS churn_flag, max(fraud_signal) AS fraud_flag FROM lm GROUP BY 1),
  w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY score, created_at, source_id) AS rn
    FROM lm WHERE sentiment IN ('negative', 'mixed')) WHERE rn = 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY created_at, source_id) AS rn,
    count(*) OVER (PARTITION BY customer_key) AS n FROM lm),
  h AS (SELECT customer_key, max(n) AS n, avg(score) FILTER (rn <= n // 2) AS older,
    avg(score) FILTER (rn > n // 2) AS recent FROM o GROUP BY 1),
  ix AS (SELECT *, concat('C', substr(author, 3)) AS customer_key FROM interactions WHERE CAST(substr(author, 3) AS INT) % 3 = 0),
  li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY opened_at DESC, issue_id DESC) AS rn
    FROM ix) WHERE rn = 1),
  f AS (SELECT c.*, 'NATION_' || city AS rm_name, s.*, h.n, h.older, h.recent, w.source_id IS NOT NULL AS bad,
    coalesce(nullif(w.root_cause, ''), nullif(w.summary, ''), '(see mention)') AS pain, w.rbi_category AS cat,
    w.recommended_team AS team, w.intent AS want, li.issue_id, li.resolved, li.customer_satisfied, li.first_response_at,
    list_transform(string_split(products_csv, ','), lambda x: lower(trim(x))) AS held
    FROM customers c LEFT JOIN s USING (customer_key) LEFT JOIN h USING (customer_key) LEFT JOIN w USING (customer_key)
    LEFT JOIN li USING (customer_key)),
  g AS (SELECT *, CASE WHEN bad THEN pain ELSE 'No negative mentions on record' END AS top_pain_point,
    CASE WHEN NOT bad THEN 'none' WHEN coalesce(cat, 'not_applicable') <> 'not_applicable' THEN cat ELSE team END AS top_pain_area,
    CASE @OFFERS@
      ELSE 'Review meeting' END AS cross_sell_product FROM f)"""


# An example of the input a house brings: product that must be missing, conditions, offer, line to say.
OFFERS = [
    ("overdraft", {"held": "fixed deposit", "intent": ("complaint", "churn_threat")}, "Bridging line", "Short of cash before the deposit is due?"),
    ("pension plan", {"held": "home loan"}, "Later-life plan", "The house is paid for one day; what then?"),
    ("current account", {"team": ("branch_ops", "cards"), "rbi_category": ("not_applicable", "credit_card")}, "Business account", "Keep shop and household apart."),
    ("gold loan", {"intent": ("other", "query")}, "Quick pledge", "Cash against what lies in the locker."),
]
_DEFAULTS = {"rbi_category": ("cat", "not_applicable"), "team": ("team", "none"), "intent": ("want", "other")}


def _offered(offer) -> str:
    missing, needs, product, _ = offer
    tests = [f"NOT list_contains(held, '{missing}')"]
    for name, allowed in needs.items():
        if name == "held":
            tests.append(f"list_contains(held, '{allowed}')")
        else:
            column, default = _DEFAULTS[name]
            tests.append(f"coalesce({column}, '{default}') IN (" + ", ".join(f"'{x}'" for x in allowed) + ")")
    return f"WHEN {' AND '.join(tests)} THEN '{product}'"


RM = RM.replace("@OFFERS@", " ".join(map(_offered, OFFERS)))


@query("mart_rm_enablement", with_ctes("mentions", "bridge", "customers", "threads") + f""", {INTERACTIONS}, {RM}
SELECT customer_key, customer_name, rm_id, rm_name, segment,
  CASE WHEN mean >= 0.15 THEN 'positive' WHEN mean <= -0.15 THEN 'negative' ELSE 'neutral' END AS current_sentiment,
  CASE WHEN n >= 2 AND recent > older + 0.1 THEN 'improving' WHEN n >= 2 AND recent < older - 0.1 THEN 'worsening'
    ELSE 'flat' END AS sentiment_trend, top_pain_point, top_pain_area, coalesce(open_issues, 0) AS open_issues,
  coalesce(churn_flag, 0) AS churn_flag, coalesce(fraud_flag, 0) AS fraud_flag, cross_sell_product,
  CASE WHEN issue_id IS NULL THEN 'no public interaction' WHEN resolved = 1 AND customer_satisfied = 1
    THEN 'resolved · satisfied' WHEN resolved = 1 THEN 'resolved' WHEN first_response_at IS NULL THEN 'awaiting response'
    ELSE 'in progress' END AS last_interaction_outcome,
  'Lead with the ' || top_pain_area || ' issue (' || top_pain_point || '); once acknowledged, pitch '
    || cross_sell_product || '.' AS talking_point FROM g""")
def _(spark, sf):
    issues_by_customer = facts.fact_interaction(A.threads(spark, sf), thread_bridge(spark, sf))
    return marts.rm_enablement(A.customers(spark, sf), A.managers(spark, sf), A.bridge(spark, sf), base(spark, sf),
                               issues_by_customer, OFFERS, ("Review meeting", "Offer a meeting.")).drop(
                                   "products_held", "cross_sell_pitch")


@query("half_split_trend", with_ctes("mentions") + """, o AS (SELECT author, score, row_number() OVER (PARTITION BY author
  ORDER BY created_at, source_id) AS rn, count(*) OVER (PARTITION BY author) AS n FROM mentions)
SELECT author, max(n) AS n_dated, avg(score) FILTER (rn <= n // 2) AS older, avg(score) FILTER (rn > n // 2) AS recent
FROM o GROUP BY author""")
def _(spark, sf):
    return marts.half_split(base(spark, sf), "author", "created_at", "score", "source_id")


SCORECARD = f"""card AS (SELECT product, count(*) AS mentions, {PCT} AS pct_negative,
  count(*) FILTER (intent = 'complaint') AS complaints, round(avg(score), 3) AS avg_score,
  round(100 * (count(*) FILTER (sentiment = 'positive') - count(*) FILTER ({NEG})) / count(*), 1) AS nps_proxy
  FROM mentions WHERE lower(coalesce(product, 'unspecified')) <> 'unspecified' GROUP BY product)"""


@query("mart_product_scorecard", MENTIONS + f", {SCORECARD} SELECT * FROM card")
def _(spark, sf):
    return marts.product_scorecard(base(spark, sf))


@query("part_scorecard", """SELECT p_type AS product, count(*) AS mentions,
  round(100 * count(*) FILTER (l_returnflag = 'R') / count(*), 1) AS pct_negative,
  count(*) FILTER (l_linestatus = 'O') AS complaints, round(avg(l_linenumber / 8.0), 3) AS avg_score,
  round(100 * (count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'R')) / count(*), 1) AS nps_proxy
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def _(spark, sf):
    lines = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tone = F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "positive")
    return marts.product_scorecard(lines.select(
        F.col("p_type").alias("product"), tone.alias("sentiment"), (F.col("l_linenumber") / 8.0).alias("score"),
        F.when(F.col("l_linestatus") == "O", "complaint").otherwise("other").alias("intent")))


@query("products_normalised", MENTIONS + f""", {SCORECARD}, c AS (SELECT *, CASE
  WHEN lower(trim(product)) LIKE '%credit%card%' THEN 'Credit card' WHEN lower(product) LIKE '%upi%' THEN 'UPI & payments'
  WHEN lower(product) LIKE '%loan%' THEN 'Loans' END AS canonical FROM card)
SELECT canonical, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(complaints) AS BIGINT) AS complaints,
  round(sum(pct_negative * mentions) / sum(mentions), 6) AS pct_negative,
  round(sum(avg_score * mentions) / sum(mentions), 6) AS avg_score FROM c WHERE canonical IS NOT NULL GROUP BY canonical""")
def _(spark, sf):
    out = marts.normalise_products(marts.product_scorecard(base(spark, sf)))
    return out.withColumns({"pct_negative": F.round("pct_negative", 6), "avg_score": F.round("avg_score", 6)})


INFLUENCERS = """w AS (SELECT author, summary, url FROM (SELECT *, row_number() OVER (PARTITION BY author
  ORDER BY score, created_at, source_id) AS rn FROM mentions) WHERE rn = 1),
 nm AS (SELECT author, author_name FROM (SELECT author, author_name, row_number() OVER (PARTITION BY author
  ORDER BY created_at DESC, source_id DESC) AS rn FROM mentions WHERE author_name IS NOT NULL) WHERE rn = 1),
 board AS (SELECT author, coalesce(any_value(author_name), author) AS author_name,
  max(greatest(coalesce(engagement, 0), coalesce(view_count, 0))) AS reach, count(*) AS mentions,
  round(avg(score), 3) AS avg_score, CASE WHEN avg(score) >= 0.15 THEN 'positive' WHEN avg(score) <= -0.15 THEN 'negative'
  ELSE 'neutral' END AS stance FROM (SELECT * EXCLUDE (author_name) FROM mentions) LEFT JOIN nm USING (author)
  GROUP BY author ORDER BY reach DESC, author LIMIT 25),
 inf AS (SELECT board.*, summary AS worst_summary, url FROM board JOIN w USING (author))"""


@query("mart_influencers", MENTIONS + f", {INFLUENCERS} SELECT * FROM inf")
def _(spark, sf):
    return marts.influencers(base(spark, sf))


@query("influencer_flags", MENTIONS + f", {INFLUENCERS} SELECT author, stance, CASE WHEN stance = 'positive' "
       "AND trim(worst_summary) <> '' THEN 'CHECK' ELSE '' END AS flag FROM inf")
def _(spark, sf):
    return marts.influencer_flags(marts.influencers(base(spark, sf))).select("author", "stance", "flag")


@query("mart_team_queue", MENTIONS + f"""SELECT coalesce(recommended_team, 'none') AS team,
  count(*) FILTER ({FOLLOW}) AS open_items, count(*) FILTER (urgency = 'critical') AS critical,
  CAST(sum(fraud_signal) AS BIGINT) AS fraud, round(avg(score), 3) AS avg_score FROM mentions GROUP BY 1""")
def _(spark, sf):
    return marts.team_queue(base(spark, sf))


@query("mart_fraud", MENTIONS + """, f AS (SELECT *, coalesce(fraud_type, 'suspected') AS kind FROM mentions
  WHERE fraud_signal = 1), a AS (SELECT kind, author, min((created_at, source_id)) AS first_at FROM f GROUP BY ALL),
 h AS (SELECT kind, string_agg(author, ', ' ORDER BY first_at, author) AS sample_handles FROM (SELECT *, row_number() OVER (
  PARTITION BY kind ORDER BY first_at, author) AS rn FROM a) WHERE rn <= 5 GROUP BY kind),
 u AS (SELECT kind, url FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at, source_id) AS rn FROM f)
  WHERE rn = 1)
SELECT kind AS fraud_type, count(*) AS cnt, any_value(sample_handles) AS sample_handles, any_value(u.url) AS sample_url,
  round(avg(score), 3) AS avg_score FROM f JOIN h USING (kind) JOIN u USING (kind) GROUP BY kind""")
def _(spark, sf):
    return marts.fraud_board(base(spark, sf))


TRENDS = """d AS (SELECT rbi_category AS category, created_date AS day, count(*) AS mentions, avg(score) AS mean
  FROM mentions GROUP BY ALL), z AS (SELECT *, CASE WHEN stddev_pop(mentions) OVER c = 0 THEN 0.0 ELSE
  round((mentions - avg(mentions) OVER c) / stddev_pop(mentions) OVER c, 2) END AS z_score FROM d
  WINDOW c AS (PARTITION BY category)),
 trends AS (SELECT day, category, mentions, round(mean, 3) AS avg_score, z_score,
  CASE WHEN z_score >= 2 AND mean < 0 THEN 1 ELSE 0 END AS anomaly FROM z)"""


@query("trends", MENTIONS + f", {TRENDS} SELECT * FROM trends")
def _(spark, sf):
    return series.trends(base(spark, sf))


@query("anomaly_feed", MENTIONS + f", {TRENDS} SELECT * FROM trends WHERE anomaly = 1")
def _(spark, sf):
    return marts.anomaly_feed(series.trends(base(spark, sf)))


def _forecast_sql(daily_sql: str) -> str:
    return f"""d AS ({daily_sql}), x AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day) - 1 AS x FROM d),
 fit AS (SELECT category, count(*) AS n, max(day) AS last, regr_slope(mentions, x) AS b, regr_intercept(mentions, x) AS a
  FROM x GROUP BY category HAVING count(*) >= 2)
SELECT category, CAST(last + (h + 1) AS DATE) AS horizon_day, round(greatest(0.0, a + b * (n + h)), 1) AS predicted_mentions,
  CASE WHEN b > 0.3 THEN 'rising' WHEN b < -0.3 THEN 'falling' ELSE 'flat' END AS trend
FROM fit, (SELECT CAST(unnest(range(3)) AS INT) AS h)"""


@query("mart_forecast", MENTIONS + ", " + _forecast_sql(
    "SELECT rbi_category AS category, created_date AS day, count(*) AS mentions FROM mentions GROUP BY ALL"))
def _(spark, sf):
    return series.forecast(series.daily_volume(series.with_category_day(base(spark, sf))))


@query("order_forecast", "WITH " + _forecast_sql(
    "SELECT o_orderpriority AS category, CAST(o_orderdate AS DATE) AS day, count(*) AS mentions FROM orders GROUP BY ALL"))
def _(spark, sf):
    days = A.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("category"), F.col("o_orderdate").cast("date").alias("day"),
        F.lit(0.0).alias("score"))
    return series.forecast(series.daily_volume(days))


@query("calendar_fill", MENTIONS + """, d AS (SELECT rbi_category AS category, created_date AS day, count(*) AS mentions
  FROM mentions GROUP BY ALL),
 cal AS (SELECT CAST(unnest(generate_series(min(created_date), max(created_date), INTERVAL 1 DAY)) AS DATE) AS day FROM mentions)
SELECT k.category, cal.day, coalesce(d.mentions, 0) AS mentions FROM (SELECT DISTINCT category FROM d) k CROSS JOIN cal
LEFT JOIN d ON d.category = k.category AND d.day = cal.day""")
def _(spark, sf):
    rows = series.with_category_day(base(spark, sf))
    volume = series.daily_volume(rows)
    return series.fill_calendar(volume, dims.dim_date(rows)).select("category", "day", "mentions")


GEO_BASE = """g AS (SELECT m.*, n_name AS city, r_name AS region FROM mentions m JOIN customer
  ON author = concat('@u', CAST(c_custkey AS STRING)) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def located(spark, sf):
    """Mentions placed by the customer's nation and region."""
    t = lambda n: A.table(spark, sf, n)
    where = (t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.concat(F.lit("@u"), F.col("c_custkey").cast("string")).alias("author"),
                     F.col("n_name").alias("city"), F.col("r_name").alias("region")))
    return base(spark, sf).join(where, "author")


@query("mart_geo", MENTIONS + f", {GEO_BASE} SELECT city, region, count(*) AS mentions, {PCT} AS pct_negative, "
       "round(avg(score), 3) AS avg_score FROM g GROUP BY ALL")
def _(spark, sf):
    return marts.geo(located(spark, sf))


@query("geo_rollup", MENTIONS + f""", {GEO_BASE} SELECT region, city, count(*) AS mentions, {PCT} AS pct_negative,
  CAST(grouping_id(region, city) AS BIGINT) AS level FROM g GROUP BY ROLLUP (region, city)""")
def _(spark, sf):
    return marts.geo_rollup(located(spark, sf))


@query("region_summary", MENTIONS + f""", {GEO_BASE}, c AS (SELECT city, region, count(*) AS mentions,
  round(avg(score), 3) AS avg_score FROM g GROUP BY ALL)
SELECT region, CAST(sum(mentions) AS BIGINT) AS mentions, round(avg(avg_score), 6) AS avg FROM c GROUP BY region""")
def _(spark, sf):
    return marts.region_summary(marts.geo(located(spark, sf))).withColumn("avg", F.round("avg", 6))


SOV = f"""sv AS (SELECT 'Acme Bank' AS brand, sentiment, score FROM mentions UNION ALL
  SELECT concat('Brand ', CAST(l_suppkey % 3 AS STRING)), CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'neutral' END,
  CAST(l_linenumber AS DOUBLE) / 8.0 FROM lineitem),
 sb AS (SELECT brand, count(*) AS mentions, {PCT} AS pct_negative, round(avg(score), 3) AS avg_score FROM sv GROUP BY brand),
 sov AS (SELECT *, round(100 * mentions / sum(mentions) OVER (), 1) AS share_of_voice FROM sb)"""


def rivals(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        F.concat(F.lit("Brand "), (F.col("l_suppkey") % 3).cast("string")).alias("brand"),
        F.when(F.col("l_returnflag") == "R", "negative").otherwise("neutral").alias("sentiment"),
        (F.col("l_linenumber") / 8.0).alias("score"))


@query("mart_competitor_sov", MENTIONS + f", {SOV} SELECT * FROM sov")
def _(spark, sf):
    return marts.share_of_voice(base(spark, sf), rivals(spark, sf))


@query("headline_kpis", MENTIONS + f"""SELECT count(*) AS mentions, round(avg(score), 3) AS net_sentiment,
  {PCT} AS pct_negative, count(*) FILTER ({NEG}) AS negative, count(*) FILTER (intent = 'complaint') AS complaints,
  count(*) FILTER (urgency = 'critical') AS critical, CAST(sum(fraud_signal) AS BIGINT) AS fraud_flags,
  CAST(sum(churn_risk) AS BIGINT) AS churn_flags FROM mentions""")
def _(spark, sf):
    return marts.headline_kpis(base(spark, sf))


FACETS = ("source", "sentiment", "urgency", "model", "lang", "emotion", "intent")


@query("preset_counts", MENTIONS + " UNION ALL ".join(
    f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM mentions GROUP BY {c}" for c in FACETS))
def _(spark, sf):
    return marts.preset_counts(base(spark, sf), FACETS)


@query("performance_index", MENTIONS + """, p AS (SELECT (avg(score) + 1) / 2 * 100 AS sentiment_balance,
  greatest(0.0, 1 - count(*) FILTER (intent = 'complaint') / count(*) / 0.40) * 100 AS complaint_load,
  greatest(0.0, 1 - count(*) FILTER (urgency IN ('critical', 'high')) / count(*) / 0.25) * 100 AS issue_severity,
  greatest(0.0, 1 - count(*) FILTER (intent IN ('fraud_report', 'churn_threat', 'legal_threat')) / count(*) / 0.10) * 100
    AS trust_safety FROM mentions),
 q AS (SELECT *, 0.35 * sentiment_balance + 0.25 * complaint_load + 0.20 * issue_severity + 0.20 * trust_safety AS s FROM p)
SELECT round(sentiment_balance, 6) AS sentiment_balance, round(complaint_load, 6) AS complaint_load,
  round(issue_severity, 6) AS issue_severity, round(trust_safety, 6) AS trust_safety, round(s, 6) AS index_score,
  CASE WHEN s >= 80 THEN 'Strong' WHEN s >= 65 THEN 'Healthy' WHEN s >= 50 THEN 'Watch' WHEN s >= 35 THEN 'Strained'
  ELSE 'Critical' END AS grade FROM q""")
def _(spark, sf):
    out = marts.performance_index(base(spark, sf))
    return out.select(*[c if c == "grade" else F.round(c, 6).alias(c) for c in out.columns])


@query("daily_totals", with_ctes("mentions", "bridge") + f""", {FACTS}, {DAILY} SELECT date_key,
  CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(negatives) AS BIGINT) AS negatives,
  CAST(sum(complaints) AS BIGINT) AS complaints, CAST(sum(fraud_ct) AS BIGINT) AS fraud_ct,
  CAST(sum(churn_ct) AS BIGINT) AS churn_ct FROM daily GROUP BY date_key""")
def _(spark, sf):
    return facts.daily_totals(daily(spark, sf))


ORDER_DAYS = """od AS (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date_key, CAST(o_orderdate AS DATE) AS day,
  count(*) AS mentions, count(*) FILTER (o_orderstatus = 'F') AS negatives, count(*) FILTER (o_orderpriority = '1-URGENT')
  AS complaints, count(*) FILTER (o_orderstatus = 'P') AS fraud_ct FROM orders GROUP BY ALL)"""


def order_days(spark, sf):
    """A daily series of several years, as long windows need it."""
    return A.table(spark, sf, "orders").groupBy(
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key")).agg(
        F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("o_orderstatus") == "F").alias("negatives"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("complaints"),
        F.count_if(F.col("o_orderstatus") == "P").alias("fraud_ct"))


@query("period_deltas", f"""WITH {ORDER_DAYS}, a AS (SELECT *, (SELECT max(day) FROM od) - day AS age FROM od)
SELECT CASE WHEN age < 30 THEN 'current' ELSE 'previous' END AS period, CAST(sum(mentions) AS BIGINT) AS mentions,
  100 * sum(negatives) / sum(mentions) AS neg_rate, CAST(sum(complaints) AS BIGINT) AS complaints,
  CAST(sum(fraud_ct) AS BIGINT) AS fraud FROM a WHERE age < 60 GROUP BY 1""")
def _(spark, sf):
    return marts.period_deltas(order_days(spark, sf))


@query("rolling_negative_rate", f"""WITH {ORDER_DAYS}, r AS (SELECT day, mentions, 100 * negatives / greatest(mentions, 1)
  AS neg_rate FROM od WHERE day >= (SELECT max(day) FROM od) - 120)
SELECT day, mentions, neg_rate, round(CASE WHEN count(*) OVER w >= 2 THEN avg(neg_rate) OVER w END, 9) AS roll
FROM r WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return series.rolling_negative_rate(order_days(spark, sf)).withColumn("roll", F.round("roll", 9))


ASPECTS = """asp AS (SELECT CASE CAST(substr(source_id, 4) AS BIGINT) % 3 WHEN 0 THEN 'mobile_app' WHEN 1 THEN 'cards'
  ELSE 'other' END AS aspect, sentiment FROM mentions UNION ALL SELECT 'fees_charges', 'neutral' FROM mentions
  WHERE CAST(substr(source_id, 4) AS BIGINT) % 4 = 0)"""


@query("aspect_pivot", MENTIONS + f""", {ASPECTS} SELECT aspect, count(*) FILTER (sentiment = 'negative') AS negative,
  count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'mixed') AS mixed, count(*) AS tot FROM asp WHERE aspect <> 'other' GROUP BY aspect
  ORDER BY tot DESC, aspect LIMIT 9""")
def _(spark, sf):
    rows = facts.fact_aspect_sentiment(with_aspects(base(spark, sf)))
    return marts.aspect_pivot(rows.groupBy("aspect", "sentiment").agg(F.count(F.lit(1)).alias("n")))


@query("category_comparison", MENTIONS + """SELECT coalesce(issue_category, 'other') AS issue_category, count(*) AS posts,
  avg(score) AS avg_score, count(*) FILTER (urgency = 'critical') AS critical, CAST(sum(fraud_signal) AS BIGINT) AS fraud
  FROM mentions GROUP BY 1""")
def _(spark, sf):
    return marts.category_comparison(base(spark, sf))


@query("thread_summary", with_ctes("threads") + f""", {INTERACTIONS}
SELECT conversation_id, count(*) AS posts, count(DISTINCT t.author) AS authors, avg(score) AS avg_score, min(score) AS worst,
  CASE WHEN count(DISTINCT t.author) >= 0.7 * count(*) THEN 'mass outrage' ELSE 'single-actor repetition' END AS kind,
  coalesce(any_value(i.n_bank_replies > 0), false) AS bank_replied
FROM t LEFT JOIN interactions i USING (conversation_id) GROUP BY conversation_id HAVING count(*) > 1""")
def _(spark, sf):
    return marts.thread_summary(A.threads(spark, sf), interactions(spark, sf))


@query("source_coverage", MENTIONS + """SELECT source, count(*) AS collected, count(*) FILTER (source <> 'news') AS classified,
  count(*) FILTER (source = 'news') AS unclassified, round(avg(CASE WHEN source <> 'news' THEN score END), 3) AS avg_sentiment
  FROM mentions GROUP BY source""")
def _(spark, sf):
    m = base(spark, sf)
    return marts.source_coverage(m, m.filter("source <> 'news'"))


@query("model_depth", MENTIONS + """SELECT model, count(*) AS posts, round(avg(confidence), 3) AS avg_confidence,
  count(DISTINCT emotion) AS distinct_emotions FROM mentions GROUP BY model""")
def _(spark, sf):
    return marts.model_depth(base(spark, sf))


@query("intent_profile", MENTIONS + """SELECT intent, count(*) AS posts, round(avg(score), 3) AS avg_score,
  CAST(sum(fraud_signal) AS BIGINT) AS fraud_flags, count(*) FILTER (urgency = 'critical') AS critical
  FROM mentions GROUP BY intent""")
def _(spark, sf):
    return marts.intent_profile(base(spark, sf))


@query("category_daily", MENTIONS + f"""SELECT created_date AS day, rbi_category AS category, count(*) AS mentions,
  round(avg(score), 3) AS avg_score, round(count(*) FILTER ({NEG}) / count(*), 3) AS neg_ratio FROM mentions GROUP BY ALL""")
def _(spark, sf):
    return marts.category_daily(base(spark, sf))


@query("team_load", MENTIONS + """SELECT recommended_team AS team, count(*) AS items,
  count(*) FILTER (urgency IN ('high', 'critical')) AS urgent, CAST(sum(fraud_signal) AS BIGINT) AS fraud
  FROM mentions GROUP BY 1""")
def _(spark, sf):
    return marts.team_load(base(spark, sf))


@query("daily_tone", MENTIONS + "SELECT created_date AS day, sentiment, count(*) AS n FROM mentions GROUP BY ALL")
def _(spark, sf):
    return marts.daily_tone(base(spark, sf))


@query("quality_snapshot", MENTIONS + """SELECT 'deep_coverage_pct' AS metric,
  round(100 * count(*) FILTER (model <> 'lexicon') / count(*), 2) AS value FROM mentions
 UNION ALL SELECT 'avg_confidence', round(avg(confidence), 3) FROM mentions
 UNION ALL SELECT 'high_conf_pct', round(100 * count(*) FILTER (confidence >= 0.5) / count(*), 2) FROM mentions""")
def _(spark, sf):
    return marts.quality_snapshot(base(spark, sf))


@query("drift_flags", MENTIONS + """, h AS (SELECT rbi_category AS metric, created_date AS run_ts,
  CAST(count(*) AS DOUBLE) AS value FROM mentions GROUP BY ALL),
 l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run_ts) AS prev,
  row_number() OVER (PARTITION BY metric ORDER BY run_ts DESC) AS rn FROM h)
SELECT metric, prev, value AS cur FROM l WHERE rn = 1 AND prev <> 0 AND (prev - value) / abs(prev) > 0.15""")
def _(spark, sf):
    history = base(spark, sf).groupBy(F.col("rbi_category").alias("metric"), F.col("created_date").alias("run_ts")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    return marts.drift_flags(history)


@query("cost_estimate", MENTIONS + """, c AS (SELECT model, count(*) AS n FROM mentions GROUP BY model)
SELECT CAST(sum(n) AS BIGINT) AS mentions, CAST(sum(n) FILTER (model <> 'lexicon') AS BIGINT) AS model_calls,
  CAST(sum(n * 500) FILTER (model <> 'lexicon') AS BIGINT) AS tokens_est,
  round(sum(n * (CASE model WHEN 'gemini-2.5-flash' THEN 300 / 1e6 * 0.30 + 200 / 1e6 * 2.50
    WHEN 'gemini-2.5-flash-lite' THEN 300 / 1e6 * 0.10 + 200 / 1e6 * 0.40 ELSE 0 END)), 4) AS cost_usd_est FROM c""")
def _(spark, sf):
    return marts.cost_estimate(base(spark, sf))


@query("customer_timeline", with_ctes("mentions", "bridge", "threads") + f""", {INTERACTIONS}
SELECT customer_key, 'mention' AS event, source_id AS ref, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, sentiment, score,
  intent AS detail FROM mentions JOIN bridge USING (author)
UNION ALL SELECT concat('C', substr(author, 3)), 'interaction', issue_id, strftime(opened_at, '%Y-%m-%d %H:%M:%S'), NULL,
  inbound_score, resolution_type FROM interactions WHERE CAST(substr(author, 3) AS INT) % 3 = 0""")
def _(spark, sf):
    rows = marts.customer_timeline(base(spark, sf), A.bridge(spark, sf),
                                   facts.fact_interaction(A.threads(spark, sf), thread_bridge(spark, sf)))
    return rows.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("customer_360", with_ctes("mentions", "bridge", "threads") + f""", {INTERACTIONS},
 e AS (SELECT customer_key, 1 AS m, score FROM mentions JOIN bridge USING (author)
  UNION ALL SELECT concat('C', substr(author, 3)), 0, NULL FROM interactions WHERE CAST(substr(author, 3) AS INT) % 3 = 0)
SELECT customer_key, count(*) FILTER (m = 1) AS mentions, count(*) FILTER (m = 0) AS interactions,
  avg(score) FILTER (m = 1) AS avg_score FROM e GROUP BY 1""")
def _(spark, sf):
    return marts.customer_summary(marts.customer_timeline(
        base(spark, sf), A.bridge(spark, sf), facts.fact_interaction(A.threads(spark, sf), thread_bridge(spark, sf))))


def _mode_sql(key: str, value: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, {value} FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key}
  ORDER BY count(*) DESC, {value}) AS rn FROM mentions WHERE {value} <> '' GROUP BY {key}, {value}) WHERE rn = 1)"""


@query("root_causes", MENTIONS + f""", {_mode_sql('cluster_id', 'root_cause', 'a')},
 {_mode_sql('cluster_id', 'recommended_action', 'b')}, {_mode_sql('cluster_id', 'recommended_team', 'c')}
SELECT cluster_id, count(*) AS posts, any_value(a.root_cause) AS root_cause, any_value(b.recommended_action)
  AS recommended_action, any_value(c.recommended_team) AS recommended_team FROM mentions LEFT JOIN a USING (cluster_id)
  LEFT JOIN b USING (cluster_id) LEFT JOIN c USING (cluster_id) GROUP BY cluster_id""")
def _(spark, sf):
    return marts.root_causes(base(spark, sf))


@query("worst_per_cluster", MENTIONS + """SELECT cluster_id, source_id, score, rank FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score, source_id) AS INT) AS rank FROM mentions) WHERE rank <= 25""")
def _(spark, sf):
    return marts.worst_per_cluster(base(spark, sf)).select("cluster_id", "source_id", "score", "rank")


@query("channel_daily", with_ctes("mentions") + f""", {SOURCES}, v AS (SELECT created_date AS full_date, source_type,
  count(*) AS mentions FROM mentions JOIN sources ON source = source_key GROUP BY ALL)
SELECT * FROM v WHERE full_date IN (SELECT DISTINCT full_date FROM v ORDER BY full_date DESC LIMIT 30)""")
def _(spark, sf):
    f = fact_rows(spark, sf)
    return marts.channel_daily(dims.vw_daily_sentiment(facts.fact_daily(f), dims.dim_date(f), dims.dim_source(spark)))


def _tile(name: str, metric: str, direction: str, where: str) -> str:
    return (f"SELECT * FROM (SELECT '{name}' AS tile, source_id, CAST({metric} AS DOUBLE) AS metric FROM mentions "
            f"WHERE {where} ORDER BY {metric} {direction}, source_id LIMIT 1)")


@query("highlights", MENTIONS + " UNION ALL ".join([
    _tile("most_reshared", "retweet_count", "DESC", "source = 'twitter' AND retweet_count <> 0"),
    _tile("most_viewed", "view_count", "DESC", "source = 'twitter' AND view_count <> 0"),
    _tile("most_replied", "reply_count", "DESC", "source = 'twitter' AND reply_count <> 0"),
    _tile("top_positive", "score", "DESC", "true"), _tile("top_negative", "score", "ASC", "true")]))
def _(spark, sf):
    return marts.highlights(base(spark, sf))


CLUSTERS = f"""{_mode_sql('cluster_id', 'theme', 'ct')}, {_mode_sql('cluster_id', 'recommended_team', 'cm')},
 cs AS (SELECT cluster_id, list(source_id ORDER BY source_id)[1:5] AS sample_ids FROM mentions GROUP BY cluster_id),
 clusters AS (SELECT cluster_id, coalesce(any_value(theme), '') AS title, count(*) AS size,
  round(avg(CASE WHEN created_at >= (SELECT max(created_at) FROM mentions) - INTERVAL 24 HOUR THEN 1 ELSE 0 END), 2) AS recent_share,
  round(avg(score), 3) AS avg_score, any_value(recommended_team) AS top_team, any_value(sample_ids) AS sample_ids
  FROM (SELECT * EXCLUDE (theme, recommended_team) FROM mentions) LEFT JOIN ct USING (cluster_id)
  LEFT JOIN cm USING (cluster_id) LEFT JOIN cs USING (cluster_id) GROUP BY cluster_id)"""


def clusters(spark, sf):
    return issues.profile(base(spark, sf))


@query("cluster_profile", MENTIONS + f", {CLUSTERS} SELECT * FROM clusters")
def _(spark, sf):
    return clusters(spark, sf)


@query("cluster_ranking", MENTIONS + f""", {CLUSTERS} SELECT cluster_id, size,
  recent_share >= 0.6 AND avg_score < 0 AND size >= 2 AS emerging FROM clusters""")
def _(spark, sf):
    return issues.ranked(clusters(spark, sf)).select("cluster_id", "size", "emerging")


@query("executive_brief", MENTIONS + f""", {CLUSTERS}, {ASPECTS},
 head AS (SELECT 'headline' AS section, 1 AS rank, count(*) || ' mentions analysed, ' || {PCT} || '% negative, '
  || count(*) FILTER (intent = 'complaint') || ' complaints, ' || count(*) FILTER (urgency = 'critical') || ' critical, '
  || sum(fraud_signal) || ' fraud, ' || sum(churn_risk) || ' churn-risk' AS line FROM mentions),
 an AS (SELECT aspect, count(*) AS n FROM asp WHERE {NEG} GROUP BY aspect),
 ar AS (SELECT *, row_number() OVER (ORDER BY n DESC, aspect) AS rank FROM an),
 cr AS (SELECT *, row_number() OVER (ORDER BY size DESC, title) AS rank FROM clusters),
 wr AS (SELECT *, row_number() OVER (ORDER BY score, CASE urgency WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium'
  THEN 2 ELSE 1 END DESC, source_id) AS rank FROM mentions WHERE score < 0)
SELECT section, CAST(rank AS INT) AS rank, line FROM head
UNION ALL SELECT 'aspects', CAST(rank AS INT), aspect || ' (' || n || ')' FROM ar WHERE rank <= 8
UNION ALL SELECT 'worst', CAST(rank AS INT), '[' || urgency || '] ' || summary || ' (' || recommended_team || ')' FROM wr
  WHERE rank <= 12""")
def _(spark, sf):
    m = base(spark, sf)
    lines = marts.brief_lines(m, facts.fact_aspect_sentiment(with_aspects(m)), clusters(spark, sf))
    # Titles repeat between clusters here, so the order of equal issues is not defined.
    return lines.filter(F.col("section") != "issues")


@query("weekly_digest", with_ctes("mentions", "threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS}, {KPIS}, {SOV},
 dc AS (SELECT cluster_id, count(*) AS size FROM mentions GROUP BY 1),
 dr AS (SELECT *, row_number() OVER (ORDER BY size DESC, 'issue ' || cluster_id) AS rank FROM dc),
 sr AS (SELECT *, row_number() OVER (ORDER BY mentions DESC, brand) AS rank FROM sov)
SELECT 'kpis' AS section, 1 AS rank, total_mentions || ' mentions, ' || pct_negative || '% negative, sentiment recovery '
  || sentiment_recovery_rate || '%, ' || needs_followup || ' need follow-up' AS line FROM kpis
UNION ALL SELECT 'share_of_voice', CAST(rank AS INT), brand || ': ' || mentions || ' mentions (' || share_of_voice
  || '% of voice), avg ' || (avg_score + 0.0) FROM sr
UNION ALL SELECT 'issues', CAST(rank AS INT), 'issue ' || cluster_id || ': ' || size || ' mentions (owner desk)' FROM dr
  WHERE rank <= 5""")
def _(spark, sf):
    m = base(spark, sf)
    titled = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).select(
        F.concat(F.lit("issue "), F.col("cluster_id").cast("string")).alias("title"), "size", F.lit("desk").alias("top_team"))
    return marts.weekly_digest(marts.kpis(thread_mentions(spark, sf), interactions(spark, sf)),
                               marts.share_of_voice(m, rivals(spark, sf)), titled)


@query("alerts", with_ctes("mentions", "threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS}, {CLUSTERS},
 tot AS (SELECT count(*) FILTER (fraud_signal = 1) AS fraud,
  count(*) FILTER (urgency = 'critical' AND coalesce(i.resolved, 0) = 0) AS crit
  FROM tm LEFT JOIN interactions i ON tm.source_id = i.inbound_source_id),
 al AS (SELECT 'emerging' AS kind, 'high' AS severity, title AS subject, 'Emerging: ' || title AS title, size || ' mentions, '
  || CAST(floor(recent_share * 100) AS INT) || '% last 24h, owner ' || top_team AS detail FROM clusters
  WHERE recent_share >= 0.6 AND avg_score < 0 AND size >= 2
 UNION ALL SELECT 'fraud', 'critical', 'fraud-volume', 'Fraud signals elevated (' || fraud || ')',
  'impersonation/phishing/scam mentions above threshold' FROM tot WHERE fraud >= 5
 UNION ALL SELECT 'sla', 'critical', 'critical-open', crit || ' critical items unresolved',
  'urgency=critical with no logged resolution' FROM tot WHERE crit >= 1)
SELECT 'alert:' || substr(md5(kind || '|' || subject), 1, 16) AS alert_id, kind, severity, title, detail FROM al""")
def _(spark, sf):
    return worklists.build_alerts(thread_mentions(spark, sf), interactions(spark, sf), clusters(spark, sf))


@query("churn_features", MENTIONS + f"""SELECT author, count(*) AS mentions, count(*) FILTER (intent = 'complaint')
  AS complaints, count(*) FILTER (intent = 'churn_threat') AS churn_threat, avg(score) AS avg_score,
  count(*) FILTER ({NEG}) / count(*) AS neg_ratio, max(churn_risk) AS churn_flag FROM mentions GROUP BY author""")
def _(spark, sf):
    return churn.features(base(spark, sf))


@query("mart_churn_risk")
def _(spark, sf):
    return churn.churn_risk(base(spark, sf), A.bridge(spark, sf), A.customers(spark, sf))


@query("churn_heuristic", MENTIONS + f"""SELECT author, round(least(greatest(0.5 * (count(*) FILTER ({NEG}) / count(*))
  + CASE WHEN count(*) FILTER (intent = 'complaint') > 0 THEN 0.3 ELSE 0 END
  + CASE WHEN count(*) FILTER (intent = 'churn_threat') > 0 THEN 0.2 ELSE 0 END, 0), 1), 9) AS prob FROM mentions GROUP BY author""")
def _(spark, sf):
    return churn.features(base(spark, sf)).select("author", F.round(churn.heuristic(), 9).alias("prob"))


GOLD = """g AS (SELECT l.doc_id, l.quality, l.toxic, CASE WHEN length(d.text) % 3 = 0 THEN 0 ELSE 1 END AS pq,
  CASE WHEN length(d.text) % 5 = 0 THEN 1 ELSE 0 END AS pt FROM labels l JOIN documents d USING (doc_id)),
 cells AS (SELECT 'quality' AS field, CAST(quality AS VARCHAR) AS gold, CAST(pq AS VARCHAR) AS predicted, count(*) AS n FROM g GROUP BY ALL
  UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), CAST(pt AS VARCHAR), count(*) FROM g GROUP BY ALL)"""


def _gold(spark, sf):
    n = F.length("text")
    predicted = A.table(spark, sf, "documents").select(
        "doc_id", F.when(n % 3 == 0, 0).otherwise(1).alias("quality"), F.when(n % 5 == 0, 1).otherwise(0).alias("toxic"))
    return A.table(spark, sf, "labels"), predicted, "doc_id", ("quality", "toxic")


@query("label_confusion", f"WITH {GOLD} SELECT * FROM cells")
def _(spark, sf):
    return marts.confusion(*_gold(spark, sf))


@query("label_accuracy", f"""WITH {GOLD} SELECT field, CAST(sum(n) AS BIGINT) AS rows,
  sum(n) FILTER (gold = predicted) / sum(n) AS accuracy FROM cells GROUP BY field""")
def _(spark, sf):
    return marts.accuracy(marts.confusion(*_gold(spark, sf)))


@query("label_class_report", f"""WITH {GOLD}, s AS (SELECT field, gold AS label, CAST(sum(n) AS BIGINT) AS support,
  CAST(coalesce(sum(n) FILTER (gold = predicted), 0) AS BIGINT) AS hits FROM cells GROUP BY ALL),
 p AS (SELECT field, predicted AS label, CAST(sum(n) AS BIGINT) AS guessed FROM cells GROUP BY ALL)
SELECT field, label, coalesce(support, 0) AS support, CASE WHEN guessed > 0 THEN coalesce(hits, 0) / guessed ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
  coalesce(hits, 0) * 2 / (coalesce(guessed, 0) + coalesce(support, 0)) AS f1 FROM s FULL JOIN p USING (field, label)""")
def _(spark, sf):
    return marts.class_report(marts.confusion(*_gold(spark, sf)))


@query("label_disagreements", f"""WITH {GOLD} SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS gold,
  CAST(pq AS VARCHAR) AS predicted FROM g WHERE quality <> pq UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR),
  CAST(pt AS VARCHAR) FROM g WHERE toxic <> pt""")
def _(spark, sf):
    return marts.disagreements(*_gold(spark, sf))
