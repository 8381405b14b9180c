"""Joins, dimensions and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmart import adapters as A
from voxmart.adapters import with_ctes
from voxmart.operators import dims, facts, scd2
from voxmart.plans.registry import query
from voxmart.schemas import empty

OWN = "lower(regexp_replace(coalesce(author, ''), '^@+', '')) IN ('bankcare', 'acmebank', 'acmebanksupport')"
NEG = "sentiment IN ('negative', 'mixed')"
FOLLOW = "(intent IN ('complaint', 'churn_threat', 'legal_threat', 'fraud_report') OR urgency IN ('high', 'critical'))"
DATE_KEY = "CAST(strftime(created_at, '%Y%m%d') AS INT)"
FACTS = ("facts AS (SELECT m.*, source AS source_key, " + DATE_KEY + " AS date_key, b.customer_key "
         "FROM mentions m LEFT JOIN bridge b USING (author))")
DAILY = ("daily AS (SELECT date_key, source_key, sentiment, count(*) AS mentions, round(avg(score), 3) AS avg_score, "
         f"count(*) FILTER ({NEG}) AS negatives, count(*) FILTER (intent = 'complaint') AS complaints, "
         "CAST(sum(fraud_signal) AS BIGINT) AS fraud_ct, CAST(sum(churn_risk) AS BIGINT) AS churn_ct "
         "FROM facts GROUP BY ALL)")
SOURCES = ("sources(source_key, source_type, medium) AS (VALUES ('news', 'news', 'aggregator'), "
           "('play', 'review', 'appstore'), ('twitter', 'social', 'microblog'), ('reddit', 'social', 'community'), "
           "('technofino', 'forum', 'community'))")
TEAMS = ("teams(recommended_team, team_name, sla_hours) AS (VALUES ('customer_support', 'Customer Support', 24), "
         "('app_engineering', 'App Engineering', 48), ('payments_upi', 'Payments / UPI', 8), ('cards', 'Cards', 24), "
         "('none', 'Unassigned', 72))")
CATEGORIES = ("categories(rbi_category, category_name, is_regulatory) AS (VALUES ('upi', 'UPI & payments', 1), "
              "('credit_card', 'Credit cards', 1), ('deposit_accounts', 'Deposit accounts', 1), "
              "('mobile_internet_banking', 'Mobile / internet banking', 1), ('not_applicable', 'Not regulatory', 0))")
# Threads: first customer post, first reply, last dated customer post.
INTERACTIONS = f"""
  t AS (SELECT *, {OWN} AS own FROM threads),
  c AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, source_id) AS first_rn,
        row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, source_id DESC) AS last_rn
        FROM t WHERE NOT own),
  r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, source_id) AS rn,
        count(*) OVER (PARTITION BY conversation_id) AS n FROM t WHERE own),
  j AS (SELECT i.conversation_id, i.source, i.author, i.source_id AS inbound_source_id, i.created_at AS opened,
        r.created_at AS answered, coalesce(r.n, 0) AS n, i.score AS inbound_score, lower(r.text) AS reply,
        CASE WHEN l.created_at > r.created_at THEN l.score END AS post_score,
        CASE WHEN l.created_at > r.created_at THEN
          CASE WHEN l.sentiment = 'positive' OR coalesce(l.score, 0) > 0.2 THEN 1 ELSE 0 END END AS satisfied
        FROM c i JOIN c l ON i.conversation_id = l.conversation_id AND l.last_rn = 1
        LEFT JOIN r ON r.conversation_id = i.conversation_id AND r.rn = 1 WHERE i.first_rn = 1),
  k AS (SELECT *, CASE WHEN reply IS NULL THEN 'none'
        WHEN contains(reply, 'refund') OR contains(reply, 'reversed') OR contains(reply, 'credited back') THEN 'refund'
        WHEN contains(reply, 'dm') OR contains(reply, 'direct message') OR contains(reply, 'escalat')
          OR contains(reply, 'raised a ticket') OR contains(reply, 'raised the ticket')
          OR contains(reply, 'team will') THEN 'escalated'
        WHEN contains(reply, 'sorry') OR contains(reply, 'apolog') OR contains(reply, 'regret')
          OR contains(reply, 'inconvenience') THEN 'apology'
        WHEN contains(reply, 'please share') OR contains(reply, 'kindly share') OR contains(reply, 'help you')
          OR contains(reply, 'assist') THEN 'info' ELSE 'responded' END AS kind FROM j),
  interactions AS (SELECT concat('conv:', conversation_id) AS issue_id, conversation_id, source, author,
        inbound_source_id, opened AS opened_at, answered AS first_response_at,
        round(date_diff('second', opened, answered) / 60, 1) AS response_latency_min, n AS n_bank_replies,
        CASE WHEN answered IS NOT NULL AND (coalesce(satisfied, 0) = 1 OR kind IN ('refund', 'escalated'))
          THEN 1 ELSE 0 END AS resolved, satisfied AS customer_satisfied, kind AS resolution_type, inbound_score,
        post_score AS post_response_score, round(post_score - inbound_score, 3) AS recovery_delta FROM k)"""


def base(spark, sf):
    return A.mentions(spark, sf)


def fact_rows(spark, sf):
    return facts.fact_mention(base(spark, sf), A.bridge(spark, sf))


def interactions(spark, sf):
    return facts.fact_interaction(A.threads(spark, sf))


def daily(spark, sf):
    return facts.fact_daily(fact_rows(spark, sf))


# Analysis rows exist for most posts only, so the outer and anti joins have work to do.
def analysed(spark, sf):
    return base(spark, sf).filter(F.col("source") != "news")


POST_COLUMNS = ("source_id", "source", "author", "author_name", "created_at", "url", "text", "engagement", "view_count")


def raw(spark, sf):
    return base(spark, sf).select(*POST_COLUMNS)


@query("scored_posts", with_ctes("mentions") + """
SELECT source_id, source, author, engagement, CASE WHEN source <> 'news' THEN sentiment END AS sentiment,
  CASE WHEN source <> 'news' THEN score END AS score, CASE WHEN source <> 'news' THEN intent END AS intent,
  CASE WHEN source <> 'news' THEN model END AS model FROM mentions""")
def _(spark, sf):
    return facts.scored_posts(raw(spark, sf), analysed(spark, sf)).select(
        "source_id", "source", "author", "engagement", "sentiment", "score", "intent", "model")


@query("mentions_inner", with_ctes("mentions") + """
SELECT source_id, author, text, sentiment, score, urgency FROM mentions WHERE source <> 'news'""")
def _(spark, sf):
    return facts.mentions(raw(spark, sf), analysed(spark, sf)).select(
        "source_id", "author", "text", "sentiment", "score", "urgency")


@query("customer_voice", with_ctes("threads") + f"SELECT source_id, author FROM threads WHERE NOT {OWN}")
def _(spark, sf):
    return facts.customer_voice(A.threads(spark, sf)).select("source_id", "author")


@query("fact_mention", with_ctes("mentions", "bridge") + f""", {FACTS}
SELECT source_id, author, customer_key, source, source_key, created_date, date_key, sentiment, score, intent, urgency,
  recommended_team, rbi_category, product, engagement, view_count, confidence, churn_risk, fraud_signal FROM facts""")
def _(spark, sf):
    return fact_rows(spark, sf).select(
        "source_id", "author", "customer_key", "source", "source_key", "created_date", "date_key", "sentiment", "score",
        "intent", "urgency", "recommended_team", "rbi_category", "product", "engagement", "view_count", "confidence",
        "churn_risk", "fraud_signal")


PROFILE = """
  reach AS (SELECT author, max(greatest(engagement, view_count)) AS reach,
            count(*) FILTER (intent = 'complaint') AS complaint_count FROM mentions GROUP BY author),
  names AS (SELECT author, author_name FROM (SELECT author, author_name, row_number() OVER (PARTITION BY author
            ORDER BY created_at DESC, source_id DESC) AS rn FROM mentions WHERE author_name IS NOT NULL) WHERE rn = 1),
  tone AS (SELECT author, sentiment FROM (SELECT author, sentiment, row_number() OVER (PARTITION BY author
           ORDER BY count(*) DESC, sentiment) AS rn FROM mentions GROUP BY author, sentiment) WHERE rn = 1),
  profile AS (SELECT r.author, coalesce(author_name, r.author) AS author_name,
    CASE WHEN reach >= 10000 THEN 'macro' WHEN reach >= 1000 THEN 'mid' WHEN reach >= 100 THEN 'micro' ELSE 'nano' END
      AS influence_tier, CASE WHEN customer_key IS NOT NULL THEN 1 ELSE 0 END AS is_customer, customer_key,
    sentiment AS typical_sentiment, complaint_count
    FROM reach r LEFT JOIN names USING (author) LEFT JOIN tone USING (author) LEFT JOIN bridge USING (author))"""


@query("author_profile", with_ctes("mentions", "bridge") + f", {PROFILE} SELECT * FROM profile")
def _(spark, sf):
    return scd2.author_profile(base(spark, sf), A.bridge(spark, sf))


def _author_history(spark, sf):
    """Two builds: half a month of posts, then all of them."""
    m, b = base(spark, sf), A.bridge(spark, sf)
    early = m.filter(F.col("created_date") < F.lit("2024-01-15").cast("date"))
    at = lambda d: F.lit(d).cast("timestamp")
    first = scd2.build_dim_author(empty(spark, "dim_author"), early, b, at("2024-01-15 00:00:00"))
    return scd2.build_dim_author(first, m, b, at("2024-02-01 00:00:00"))


_EARLY = PROFILE.replace("reach AS", "e_reach AS").replace("names AS", "e_names AS").replace("tone AS", "e_tone AS") \
    .replace("profile AS", "early AS").replace("FROM reach r", "FROM e_reach r").replace(
        "JOIN names", "JOIN e_names").replace("JOIN tone", "JOIN e_tone").replace("FROM mentions", "FROM em")
HISTORY = f"""em AS (SELECT * FROM mentions WHERE created_date < DATE '2024-01-15'), {_EARLY}, {PROFILE},
  chg AS (SELECT p.author, e.author IS NULL AS fresh, e.author IS NOT NULL AND (e.author_name, e.influence_tier,
    e.is_customer, coalesce(e.customer_key, ''), e.typical_sentiment, e.complaint_count) IS DISTINCT FROM (p.author_name,
    p.influence_tier, p.is_customer, coalesce(p.customer_key, ''), p.typical_sentiment, p.complaint_count) AS changed
    FROM profile p LEFT JOIN early e USING (author)),
  history AS (
    SELECT concat(e.author, '#v1') AS author_key, e.*, '2024-01-15' AS valid_from,
      CASE WHEN changed THEN '2024-02-01' END AS valid_to, CASE WHEN changed THEN 0 ELSE 1 END AS is_current, 1 AS version
    FROM early e JOIN chg USING (author)
    UNION ALL
    SELECT concat(p.author, CASE WHEN fresh THEN '#v1' ELSE '#v2' END), p.*, '2024-02-01', NULL, 1,
      CASE WHEN fresh THEN 1 ELSE 2 END FROM profile p JOIN chg USING (author) WHERE fresh OR changed)"""


@query("dim_author_scd2", with_ctes("mentions", "bridge") + f""", {HISTORY} SELECT * FROM history""")
def _(spark, sf):
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return _author_history(spark, sf).select(
        "author_key", "author", "author_name", "influence_tier", "is_customer", "customer_key", "typical_sentiment",
        "complaint_count", day("effective_from", "valid_from"), day("effective_to", "valid_to"), "is_current", "version")


@query("fact_author_key", with_ctes("mentions", "bridge") + f""", {HISTORY}
SELECT source_id, author_key FROM mentions LEFT JOIN (SELECT author, author_key FROM history WHERE is_current = 1)
USING (author)""")
def _(spark, sf):
    return facts.fact_mention(base(spark, sf), A.bridge(spark, sf), _author_history(spark, sf)).select(
        "source_id", "author_key")


@query("author_as_of", with_ctes("mentions", "bridge") + f""", {HISTORY}
SELECT source_id, author_key, version FROM mentions m LEFT JOIN history h ON m.author = h.author
  AND m.created_at >= CAST(valid_from AS TIMESTAMP)
  AND (valid_to IS NULL OR m.created_at < CAST(valid_to AS TIMESTAMP))""")
def _(spark, sf):
    return facts.author_as_of(base(spark, sf), _author_history(spark, sf)).select("source_id", "author_key", "version")


@query("scd2_customer", """
WITH a AS (SELECT concat('C', CAST(c_custkey AS STRING)) AS customer_key, c_mktsegment AS segment, c_acctbal AS clv,
  CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS risk_flag, c_custkey FROM customer)
SELECT customer_key, segment, clv, risk_flag, 1 AS version, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS is_current
FROM a WHERE c_custkey % 7 <> 0
UNION ALL SELECT customer_key, 'UPGRADED', clv, risk_flag, 2, 1 FROM a WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0
UNION ALL SELECT customer_key, CASE WHEN c_custkey % 5 = 0 THEN 'UPGRADED' ELSE segment END, clv, risk_flag, 1, 1
FROM a WHERE c_custkey % 7 = 0""")
def _(spark, sf):
    key = F.expr("CAST(substring(customer_key, 2) AS BIGINT)")
    now = A.customers(spark, sf).select("customer_key", "segment", "clv", "risk_flag")
    schema = spark.createDataFrame([], now.schema).selectExpr(
        "*", "CAST(NULL AS timestamp) AS effective_from", "CAST(NULL AS timestamp) AS effective_to",
        "CAST(NULL AS int) AS is_current", "CAST(NULL AS int) AS version")
    check = ("segment", "clv", "risk_flag")
    v1 = scd2.merge(schema, now.filter(key % 7 != 0), "customer_key", check, F.lit("2024-01-01").cast("timestamp"))
    moved = now.withColumn("segment", F.when(key % 5 == 0, "UPGRADED").otherwise(F.col("segment")))
    v2 = scd2.merge(v1, moved, "customer_key", check, F.lit("2024-02-01").cast("timestamp"))
    return v2.select("customer_key", "segment", "clv", "risk_flag", "version", "is_current")


@query("fact_aspect_sentiment", with_ctes("mentions") + """
SELECT source_id, aspect, aspect_sentiment AS sentiment, summary AS evidence FROM (
  SELECT source_id, summary, sentiment AS aspect_sentiment, CASE CAST(substr(source_id, 4) AS BIGINT) % 3 WHEN 0 THEN
  'mobile_app' WHEN 1 THEN 'cards' ELSE 'other' END AS aspect FROM mentions
  UNION ALL SELECT source_id, summary, 'neutral', 'fees_charges' FROM mentions
  WHERE CAST(substr(source_id, 4) AS BIGINT) % 4 = 0)""")
def _(spark, sf):
    return facts.fact_aspect_sentiment(with_aspects(base(spark, sf)))


def with_aspects(rows):
    n = F.expr("CAST(substring(source_id, 4) AS BIGINT)")
    def item(a, s):
        return F.struct(a.alias("aspect"), s.alias("sentiment"), F.col("summary").alias("evidence"))
    first = F.when(n % 3 == 0, "mobile_app").when(n % 3 == 1, "cards").otherwise("other")
    second = F.when(n % 4 == 0, item(F.lit("fees_charges"), F.lit("neutral")))
    return rows.withColumn("aspects", F.array_compact(F.array(item(first, F.col("sentiment")), second)))


@query("fact_interaction", with_ctes("threads") + f""", {INTERACTIONS}
SELECT * EXCLUDE (opened_at, first_response_at), strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS opened,
  strftime(first_response_at, '%Y-%m-%d %H:%M:%S') AS answered FROM interactions""")
def _(spark, sf):
    stamp = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    rows = interactions(spark, sf)
    return rows.select(*[c for c in rows.columns if c not in ("customer_key", "opened_at", "first_response_at")],
                       stamp("opened_at", "opened"), stamp("first_response_at", "answered"))


@query("fact_daily", with_ctes("mentions", "bridge") + f", {FACTS}, {DAILY} SELECT * FROM daily")
def _(spark, sf):
    return daily(spark, sf)


@query("dim_date", with_ctes("mentions") + """
SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INT) AS year,
  CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, strftime(d, '%b') AS month_name,
  CAST(weekofyear(d) AS INT) AS week, CAST(day(d) AS INT) AS day, CAST(isodow(d) - 1 AS INT) AS day_of_week,
  strftime(d, '%a') AS day_name, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM (SELECT unnest(generate_series(min(created_date), max(created_date), INTERVAL 1 DAY)) AS d FROM mentions)""")
def _(spark, sf):
    return dims.dim_date(base(spark, sf))


@query("vw_mention", with_ctes("mentions", "bridge") + f""", {FACTS}, {SOURCES}, {TEAMS}, {CATEGORIES}
SELECT source_id, f.created_date, CAST(year(created_date) AS INT) AS year, strftime(created_date, '%a') AS day_name,
  source_type, medium, team_name, sla_hours, category_name, is_regulatory, theme, root_cause, fraud_type,
  influence_tier FROM facts f LEFT JOIN sources USING (source_key) LEFT JOIN teams USING (recommended_team)
  LEFT JOIN categories USING (rbi_category) LEFT JOIN (SELECT author, CASE WHEN max(greatest(engagement, view_count))
  >= 10000 THEN 'macro' WHEN max(greatest(engagement, view_count)) >= 1000 THEN 'mid' WHEN max(greatest(engagement,
  view_count)) >= 100 THEN 'micro' ELSE 'nano' END AS influence_tier FROM mentions GROUP BY author) USING (author)""")
def _(spark, sf):
    m = base(spark, sf)
    at = F.lit("2024-02-01").cast("timestamp")
    authors = scd2.build_dim_author(empty(spark, "dim_author"), m, A.bridge(spark, sf), at)
    view = dims.vw_mention(facts.fact_mention(m, A.bridge(spark, sf), authors), m, dims.dim_date(m),
                           dims.dim_source(spark), authors, dims.dim_team(spark), dims.dim_category(spark))
    return view.select("source_id", "created_date", "year", "day_name", "source_type", "medium", "team_name",
                       "sla_hours", "category_name", "is_regulatory", "theme", "root_cause", "fraud_type",
                       "influence_tier")


@query("vw_daily_sentiment", with_ctes("mentions", "bridge") + f""", {FACTS}, {DAILY}, {SOURCES}
SELECT date_key, CAST(strptime(CAST(date_key AS VARCHAR), '%Y%m%d') AS DATE) AS full_date, source_key, source_type,
  sentiment, mentions, avg_score, negatives FROM daily LEFT JOIN sources USING (source_key)""")
def _(spark, sf):
    f = fact_rows(spark, sf)
    return dims.vw_daily_sentiment(facts.fact_daily(f), dims.dim_date(f), dims.dim_source(spark)).select(
        "date_key", "full_date", "source_key", "source_type", "sentiment", "mentions", "avg_score", "negatives")


@query("unmatched_sources", "SELECT source AS source_key, count(*) AS mentions FROM documents GROUP BY 1")
def _(spark, sf):
    return dims.unmatched_sources(A.posts(spark, sf).withColumn("source_key", F.col("source")), dims.dim_source(spark))


@query("public_source_count", """SELECT count(DISTINCT s) AS public_sources FROM (SELECT source AS s FROM documents
UNION ALL SELECT CASE event_id % 5 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' WHEN 2 THEN 'play' WHEN 3 THEN 'news'
ELSE 'technofino' END FROM events)""")
def _(spark, sf):
    both = A.posts(spark, sf).select("source").unionByName(base(spark, sf).select("source"))
    return dims.public_source_count(both, dims.dim_source(spark))


@query("customer_mentions", with_ctes("mentions", "bridge") + """
SELECT customer_key, count(*) AS mentions, avg(score) AS avg_score FROM mentions JOIN bridge USING (author)
GROUP BY customer_key""")
def _(spark, sf):
    linked = base(spark, sf).join(A.bridge(spark, sf), "author")
    return linked.groupBy("customer_key").agg(F.count(F.lit(1)).alias("mentions"), F.avg("score").alias("avg_score"))


@query("interaction_customer", with_ctes("threads") + f""", {INTERACTIONS}
SELECT issue_id, CASE WHEN CAST(substr(author, 3) AS INT) % 3 = 0 THEN concat('C', substr(author, 3)) END AS customer_key
FROM interactions""")
def _(spark, sf):
    return facts.fact_interaction(A.threads(spark, sf), thread_bridge(spark, sf)).select("issue_id", "customer_key")


def thread_bridge(spark, sf):
    """Thread authors linked to customers (every third)."""
    return A.table(spark, sf, "customer").filter("c_custkey % 3 = 0").selectExpr(
        "concat('@c', CAST(c_custkey AS STRING)) AS author", "concat('C', CAST(c_custkey AS STRING)) AS customer_key")
