"""Interactive reads: filters, lanes, ranking, work lists, engagement refresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from voxmart import adapters as A
from voxmart.adapters import with_ctes
from voxmart.operators import cleaning, feed, places, worklists
from voxmart.plans.catalog_facts import FOLLOW, INTERACTIONS, NEG, base, interactions
from voxmart.plans.catalog_marts import CLUSTERS, GEO_BASE, PCT, clusters, located, thread_mentions, THREAD_MENTIONS
from voxmart.operators import marts
from voxmart.plans.registry import query

M = with_ctes("mentions")
IDS = M + "SELECT source_id FROM mentions WHERE "
RANK = "CASE urgency WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
RISKY = "intent IN ('fraud_report', 'legal_threat', 'churn_threat')"
AS_OF = "2024-01-31 00:00:00"


def ids(df):
    return df.select("source_id")


STACK = (
    {"field": "Category", "op": "is not", "value": "praise"},
    {"field": "Urgency", "op": "is any of", "value": ["high", "critical", "medium"]},
    {"field": "Views", "op": feed.GE, "value": 300}, {"field": "Reshares", "op": "between", "value": (10, 2000)},
    {"field": "Fraud flag", "op": "is", "value": "No"}, {"field": "Sentiment", "op": "is", "value": None},
    {"field": "No such field", "op": "is", "value": 1})


@query("filter_stack", IDS + """coalesce(issue_category, '') <> 'praise' AND urgency IN ('high', 'critical', 'medium')
  AND view_count >= 300 AND retweet_count BETWEEN 10 AND 2000 AND fraud_signal = 0""")
def _(spark, sf):
    return ids(feed.apply_filters(base(spark, sf), STACK))


@query("filter_description", M + """,
 chips AS (SELECT * FROM (VALUES (0, 'Category is not Praise'), (1, 'Urgency is any of high, critical, medium'),
 (2, 'Views ≥ 300'), (3, 'Reshares between 10–2000'), (4, 'Fraud flag is No')) AS v(pos, chip))
SELECT pos, chip, CASE pos WHEN 0 THEN count(*) FILTER (coalesce(issue_category, '') <> 'praise')
 WHEN 1 THEN count(*) FILTER (urgency IN ('high', 'critical', 'medium')) WHEN 2 THEN count(*) FILTER (view_count >= 300)
 WHEN 3 THEN count(*) FILTER (retweet_count BETWEEN 10 AND 2000) ELSE count(*) FILTER (fraud_signal = 0) END AS rows
FROM chips CROSS JOIN mentions GROUP BY pos, chip""")
def _(spark, sf):
    rows = base(spark, sf)
    chips = [f for f in STACK if feed.condition(rows, f) is not None]
    one = rows.agg(*[F.count_if(F.coalesce(feed.condition(rows, f), F.lit(False))).alias(f"c{i}")
                     for i, f in enumerate(chips)])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("pos"), F.lit(feed.describe(f)).alias("chip"), F.col(f"c{i}").alias("rows"))
        for i, f in enumerate(chips)])))


for _w, _span in (("1h", "1 HOUR"), ("1d", "1 DAY"), ("1m", "30 DAY")):
    @query(f"window_{_w}", IDS + f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {_span}")
    def _(spark, sf, w=_w):
        return ids(feed.within(base(spark, sf), F.lit(AS_OF).cast("timestamp"), w))


@query("month_options", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, sf):
    rows = A.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return feed.month_options(rows).select(F.date_format("month", "yyyy-MM").alias("month"))


@query("month_filter", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-05'")
def _(spark, sf):
    rows = A.table(spark, sf, "orders").withColumn("created_at", F.col("o_orderdate").cast("timestamp"))
    return feed.in_month(rows, 1997, 5).select("o_orderkey")


@query("text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def _(spark, sf):
    return feed.text_search(A.table(spark, sf, "documents"), "The").select("doc_id")


@query("search_mentions", IDS + """contains(lower(text), 'error') AND source = 'twitter' AND urgency = 'high'
  AND created_at >= TIMESTAMP '2024-01-10' ORDER BY created_at DESC, source_id LIMIT 50""")
def _(spark, sf):
    return ids(feed.search_mentions(base(spark, sf), "Error", since="2024-01-10", source="twitter", urgency="high"))


@query("war_room_filters", IDS + """source IN ('twitter', 'reddit') AND urgency IN ('high', 'critical')
  AND lang IN ('en', 'hi') AND churn_risk = 1""")
def _(spark, sf):
    return ids(feed.in_lists(base(spark, sf), churn=True, source=["twitter", "reddit"], urgency=["high", "critical"],
                             lang=["en", "hi"], sentiment=[]))


LANE_SQL = {
    "all": "true", "risk": f"fraud_signal = 1 OR churn_risk = 1 OR {RISKY}", "fraud": "fraud_signal = 1",
    "sarcasm": "sarcasm = 1 OR (model <> 'lexicon' AND score < -0.5 AND sentiment = 'negative')",
    "pii": "pii_present = 1", "press": "source = 'news'"}
for _name, _where in LANE_SQL.items():
    @query(f"lane_{_name}", IDS + _where)
    def _(spark, sf, name=_name):
        return ids(feed.lane(base(spark, sf), name))


@query("lane_gap", with_ctes("threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS} SELECT source_id FROM tm
  WHERE score < 0 AND (urgency IN ('critical', 'high') OR {RISKY} OR fraud_signal = 1) AND source_id NOT IN (
  SELECT inbound_source_id FROM interactions WHERE n_bank_replies > 0)""")
def _(spark, sf):
    return ids(feed.lane(thread_mentions(spark, sf), "gap", feed.answered_ids(interactions(spark, sf))))


@query("lane_query", with_ctes("threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS} SELECT source_id FROM tm
  WHERE intent = 'query' AND source_id NOT IN (SELECT inbound_source_id FROM interactions WHERE n_bank_replies > 0)""")
def _(spark, sf):
    return ids(feed.lane(thread_mentions(spark, sf), "query", feed.answered_ids(interactions(spark, sf))))


@query("answered_split", with_ctes("threads") + f""", {INTERACTIONS}, {THREAD_MENTIONS}
SELECT source_id, source_id IN (SELECT inbound_source_id FROM interactions WHERE n_bank_replies > 0) AS answered FROM tm""")
def _(spark, sf):
    rows, done = ids(thread_mentions(spark, sf)), feed.answered_ids(interactions(spark, sf))
    return (rows.join(done, "source_id", "left_semi").withColumn("answered", F.lit(True))
            .unionByName(rows.join(done, "source_id", "left_anti").withColumn("answered", F.lit(False))))


@query("lane_strip", M + """SELECT count(*) AS posts, avg(score) AS avg_score, count(*) FILTER (urgency = 'critical')
  AS critical, CAST(sum(fraud_signal) AS BIGINT) AS fraud_flags, count(*) FILTER (model <> 'lexicon') AS deep_read
  FROM mentions WHERE fraud_signal = 1 OR churn_risk = 1""")
def _(spark, sf):
    return feed.lane_strip(feed.lane(base(spark, sf), "risk"))


TRIAGE = """tr AS (SELECT *, round((CASE urgency WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'medium' THEN 1.6 ELSE 1.0 END)::DOUBLE
 * (CASE intent WHEN 'fraud_report' THEN 3.0 WHEN 'churn_threat' THEN 2.6 WHEN 'complaint' THEN 1.8 WHEN 'query' THEN 1.2
    ELSE 0.3 END)::DOUBLE * (1 + ln(1 + greatest(engagement, coalesce(view_count, 0))) / 4.0::DOUBLE)
 * (greatest(-score, 0.0) + 0.35::DOUBLE) * (1 + 0.5::DOUBLE * fraud_signal + 0.3::DOUBLE * churn_risk), 2) AS triage FROM mentions)"""


@query("triage_feed", M + f", {TRIAGE} SELECT source_id, triage FROM tr ORDER BY triage DESC, source_id LIMIT 25")
def _(spark, sf):
    return feed.triage(base(spark, sf)).select("source_id", "triage")


@query("triage_score", M + f", {TRIAGE} SELECT source_id, triage FROM tr")
def _(spark, sf):
    return feed.with_triage(base(spark, sf)).select("source_id", "triage")


@query("feed_page", M + f""", {TRIAGE} SELECT source_id, triage FROM tr WHERE (fraud_signal = 1 OR churn_risk = 1 OR {RISKY})
  AND issue_category = 'scam' AND contains(text, 'saw') AND sentiment = 'negative' AND strftime(created_at, '%Y-%m') = '2024-01'
  ORDER BY triage DESC, source_id LIMIT 25""")
def _(spark, sf):
    return feed.feed(base(spark, sf), "risk", month=(2024, 1), category="scam", query="SAW",
                     filters=[{"field": "Sentiment", "op": "is", "value": "negative"}]).select("source_id", "triage")


@query("priority_queue", M + f"""SELECT source_id, recommended_action, round({RANK} * (1 + sqrt(engagement))
  * (0.5::DOUBLE + greatest(-score, 0.0)), 2) AS priority FROM mentions WHERE {NEG} OR urgency IN ('critical', 'high')
  ORDER BY priority DESC, source_id LIMIT 20""")
def _(spark, sf):
    return feed.priority_queue(base(spark, sf)).select("source_id", "recommended_action", "priority")


@query("urgency_order", M + f"SELECT source_id, {RANK} AS urgency_rank FROM mentions")
def _(spark, sf):
    from voxmart.functions.labels import urgency_rank
    return base(spark, sf).select("source_id", urgency_rank(F.col("urgency")).alias("urgency_rank"))


@query("team_worklist", M + f"""SELECT recommended_team, source_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY
  recommended_team ORDER BY {RANK} DESC, source_id) AS INT) AS rank FROM mentions WHERE {FOLLOW}) WHERE rank <= 40""")
def _(spark, sf):
    return feed.team_worklist(base(spark, sf)).select("recommended_team", "source_id", "rank")


@query("newest_ticker", M + "SELECT source_id FROM mentions ORDER BY created_at DESC, source_id LIMIT 30")
def _(spark, sf):
    return ids(feed.newest(base(spark, sf)))


@query("sort_by_views", M + """SELECT source_id, CAST(row_number() OVER (ORDER BY view_count DESC NULLS LAST, source_id) AS INT)
  AS place FROM mentions""")
def _(spark, sf):
    return feed.places(base(spark, sf), "Views").select("source_id", F.col("place").cast("int").alias("place"))


@query("sort_by_fields", M + " " + " UNION ALL ".join(
    f"""SELECT '{field}' AS field, {str(up).lower()} AS ascending, source_id,
        row_number() OVER (ORDER BY {column} {'ASC' if up else 'DESC'} NULLS LAST, source_id) AS place FROM mentions"""
    for field, column in feed.SORTS.items() if column != "reach" for up in (False, True)))
def _(spark, sf):
    rows = base(spark, sf)  # only the sorted column travels with the ids
    out = [feed.places(rows.select("source_id", column), field, up).select(F.lit(field).alias("field"), F.lit(up).alias("ascending"), "source_id", "place")
           for field, column in feed.SORTS.items() if column != "reach" for up in (False, True)]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("risk_set", M + f"""SELECT source_id, source, author, intent, urgency, score, fraud_type, recommended_team,
  coalesce(text_masked, text) AS excerpt, {RANK} AS urgency_rank FROM mentions
  WHERE fraud_signal = 1 OR churn_risk = 1 OR {RISKY}""")
def _(spark, sf):
    return feed.risk_set(base(spark, sf))


@query("pii_set", M + """SELECT source_id, source, author, pii_types, text_masked AS masked_excerpt
  FROM mentions WHERE pii_present = 1""")
def _(spark, sf):
    return feed.pii_set(base(spark, sf))


@query("loudest_posts", M + "SELECT source_id, view_count FROM mentions WHERE view_count > 0 "
       "ORDER BY view_count DESC, source_id LIMIT 15")
def _(spark, sf):
    return feed.loudest(base(spark, sf)).select("source_id", "view_count")


@query("recent_fraud", M + "SELECT source_id FROM mentions WHERE fraud_signal = 1 ORDER BY created_at DESC, source_id LIMIT 30")
def _(spark, sf):
    return ids(feed.recent_fraud(base(spark, sf)))


@query("negative_themes", M + """, clusters AS (SELECT author AS cluster_id, count(*) AS size, round(avg(score), 3) AS avg_score FROM mentions GROUP BY author)
 SELECT cluster_id, size, avg_score FROM clusters WHERE avg_score < -0.05 AND size >= 3 ORDER BY size DESC, cluster_id LIMIT 12""")
def _(spark, sf):
    """The posts of an author stand for a cluster: among them some are negative on the whole."""
    by_author = base(spark, sf).groupBy(F.col("author").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("score"), 3).alias("avg_score"))
    return feed.negative_themes(by_author).select("cluster_id", "size", "avg_score")


@query("worst_cities", M + f""", {GEO_BASE} SELECT city, pct_negative FROM (SELECT city, count(*) AS mentions, {PCT} AS pct_negative
  FROM g GROUP BY city, region) WHERE mentions >= 3 ORDER BY pct_negative DESC, city LIMIT 8""")
def _(spark, sf):
    return feed.worst_cities(marts.geo(located(spark, sf))).select("city", "pct_negative")


@query("mart_page", M + """SELECT source_id FROM mentions ORDER BY engagement DESC, source_id LIMIT 20 OFFSET 40""")
def _(spark, sf):
    return ids(feed.page(base(spark, sf), (F.desc("engagement"), "source_id"), limit=20, offset=40))


@query("customer_lookup", with_ctes("customers") + "SELECT customer_key, customer_name FROM customers WHERE customer_key = 'C7'")
def _(spark, sf):
    return feed.point_lookup(A.customers(spark, sf), customer_key="C7").select("customer_key", "customer_name")


@query("explorer_frame", M + """SELECT source_id, coalesce(text_masked, text) AS post, coalesce(author_name, author, '—') AS account,
  source, CASE issue_category WHEN 'branch' THEN 'Branch & ATM' WHEN 'technical_issue' THEN 'Technical issue'
   WHEN 'scam' THEN 'Scam / impersonation' WHEN 'praise' THEN 'Praise' WHEN 'charges_dispute' THEN 'Charges & fees'
   WHEN 'service_delay' THEN 'Service delay' ELSE '—' END AS category, coalesce(view_count, 0) AS view_count, engagement,
  coalesce(retweet_count, 0) AS retweet_count, coalesce(reply_count, 0) AS reply_count, sentiment, round(score, 3) AS score,
  round(confidence, 2) AS confidence, intent, urgency, CASE WHEN model <> 'lexicon' THEN emotion END AS emotion, recommended_team,
  product, fraud_signal = 1 AS fraud_signal, churn_risk = 1 AS churn_risk, pii_present = 1 AS pii_present, model FROM mentions""")
def _(spark, sf):
    return feed.explorer_frame(base(spark, sf))


@query("shallow_reads", M + "SELECT source_id, model = 'lexicon' AS shallow FROM mentions")
def _(spark, sf):
    return base(spark, sf).select("source_id", feed.is_shallow().alias("shallow"))


@query("read_only_sql", M + "SELECT source, count(*) AS n FROM mentions GROUP BY source")
def _(spark, sf):
    base(spark, sf).createOrReplaceTempView("voxmart_mentions")
    return feed.read_only_sql(spark, "SELECT source, count(*) AS n FROM voxmart_mentions GROUP BY source;")


@query("reply_worklist", M + f"""SELECT source_id, urgency, score FROM mentions WHERE {NEG} AND intent IN ('complaint', 'churn_threat',
  'legal_threat', 'fraud_report') AND CAST(substr(source_id, 4) AS BIGINT) % 4 <> 0 ORDER BY {RANK} DESC, score, source_id""")
def _(spark, sf):
    m = base(spark, sf)
    drafted = m.filter(F.expr("CAST(substring(source_id, 4) AS BIGINT) % 4 = 0"))
    return worklists.reply_worklist(m, drafted).select("source_id", "urgency", "score")


@query("reply_drafts", M + f""", w AS (SELECT * FROM mentions WHERE {NEG} AND intent IN ('complaint', 'churn_threat',
  'legal_threat', 'fraud_report') ORDER BY {RANK} DESC, score, source_id)
SELECT source_id, urgency, author, text_masked AS complaint, 'Thank you for telling us. Acme Bank looks into it and will answer here.' AS draft,
 'template' AS model, url FROM w""")
def _(spark, sf):
    m = base(spark, sf)
    return worklists.drafts_view(worklists.template_drafts(worklists.reply_worklist(m), "Thank you for telling us. {brand} looks into it and will answer here."), m)


@query("translation_worklist", M + """SELECT source_id, lang, text AS english, 'passthrough' AS model FROM mentions
  WHERE lang IN ('hi', 'hi-en') AND source <> 'news'""")
def _(spark, sf):
    clean = base(spark, sf).withColumn("clean_text", F.col("text"))
    todo = worklists.translation_worklist(clean, clean.filter("source = 'news'"))
    return worklists.passthrough_translations(todo)


@query("language_view", M + """SELECT source_id, author, CASE WHEN source = 'news' THEN text END AS english,
  coalesce(CASE WHEN source <> 'play' THEN lang END, lang) AS effective_lang FROM mentions""")
def _(spark, sf):
    m = base(spark, sf)
    clean = m.select("source_id", F.col("text").alias("clean_text"), F.when(F.col("source") != "play", F.col("lang")).alias("lang"))
    done = m.filter("source = 'news'").select("source_id", F.col("text").alias("english"))
    return worklists.language_view(clean, m, done).select("source_id", "author", "english", "effective_lang")


# ---------------------------------------------------------------- engagement refresh
REFRESH = """rp AS (SELECT *, created_at AS fetched_at, CASE WHEN refresh_count > 0 THEN created_at + INTERVAL (refresh_count * 2) HOUR
  END AS last_refreshed_at FROM mentions),
 due AS (SELECT * FROM rp WHERE refresh_count < 12 AND TIMESTAMP '2024-01-30 12:00:00' <= fetched_at + INTERVAL 24 HOUR
  AND (last_refreshed_at IS NULL OR TIMESTAMP '2024-01-30 12:00:00' >= last_refreshed_at + INTERVAL 2 HOUR)
  AND source IN ('reddit', 'hackernews', 'mastodon', 'twitter'))"""


def refreshable(spark, sf):
    exact = F.timestamp_micros(F.unix_micros("created_at") + F.col("refresh_count").cast("bigint") * 7200000000)
    return base(spark, sf).withColumns({"fetched_at": F.col("created_at"),
                                        "last_refreshed_at": F.when(F.col("refresh_count") > 0, exact)})


def _due(spark, sf):
    return worklists.refresh_due(refreshable(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query("refresh_due", M + f", {REFRESH} SELECT source_id, refresh_count FROM due")
def _(spark, sf):
    return _due(spark, sf).select("source_id", "refresh_count")


MET = """met AS (SELECT source_id, engagement + 5 AS likes, CASE WHEN source = 'twitter' THEN retweet_count + 2 END AS reshares,
  CASE WHEN source = 'twitter' THEN view_count * 2 END AS views FROM mentions WHERE lang <> 'hi')"""


def _metrics(spark, sf):
    m, tw = base(spark, sf), F.col("source") == "twitter"
    return m.filter("lang <> 'hi'").select(
        "source_id", (F.col("engagement") + 5).alias("likes"), F.when(tw, F.col("retweet_count") + 2).alias("reshares"),
        F.lit(None).cast("bigint").alias("comments"), F.when(tw, F.col("view_count") * 2).alias("views"))


@query("refresh_apply", M + f""", {REFRESH}, {MET} SELECT source_id, refresh_count + 1 AS refresh_count,
  coalesce(likes, engagement) AS engagement, coalesce(reshares, retweet_count) AS retweet_count, reply_count,
  coalesce(views, view_count) AS view_count FROM due LEFT JOIN met USING (source_id)""")
def _(spark, sf):
    patched, _h = worklists.apply_refresh(_due(spark, sf), _metrics(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return patched.select("source_id", "refresh_count", "engagement", "retweet_count", "reply_count", "view_count")


@query("refresh_history", M + f""", {REFRESH}, {MET} SELECT source_id, refresh_count + 1 AS iteration, likes, reshares, views
  FROM due JOIN met USING (source_id)""")
def _(spark, sf):
    _p, history = worklists.apply_refresh(_due(spark, sf), _metrics(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return history.select("source_id", "iteration", "likes", "reshares", "views")


@query("engagement_velocity", M + """, h AS (SELECT author AS source_id, CAST(row_number() OVER (PARTITION BY author ORDER BY
  created_at, source_id) AS INT) AS iteration, engagement AS likes, view_count AS views FROM mentions)
SELECT source_id, iteration, likes - lag(likes) OVER w AS likes_delta, views - lag(views) OVER w AS views_delta FROM h
WINDOW w AS (PARTITION BY source_id ORDER BY iteration)""")
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("author").orderBy("created_at", "source_id")
    history = base(spark, sf).select(
        F.row_number().over(w).alias("iteration"), F.col("author").alias("source_id"), F.col("created_at").alias("captured_at"),
        F.col("engagement").alias("likes"), F.col("retweet_count").alias("reshares"), F.col("reply_count").alias("comments"),
        F.col("view_count").alias("views"))
    return worklists.velocity(history).select("source_id", "iteration", "likes_delta", "views_delta")


@query("refresh_status", M + """SELECT source, count(*) AS posts, CAST(sum(refresh_count) AS BIGINT) AS passes,
  CASE WHEN source IN ('reddit', 'hackernews', 'mastodon', 'twitter') THEN 'LIVE' ELSE 'skipped' END AS state FROM mentions
  GROUP BY source""")
def _(spark, sf):
    return worklists.refresh_status(base(spark, sf))


@query("backfill_windows", """WITH span AS (SELECT CAST(max(ts) AS DATE) AS hi, CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE)
  AS days FROM events), w AS (SELECT hi, days, unnest(range(0, greatest(days, 1), 7)) AS back FROM span)
SELECT greatest(hi - CAST(days AS INT), hi - CAST(back + 7 AS INT)) AS since, hi - CAST(back AS INT) AS until FROM w""")
def _(spark, sf):
    lo, hi = base(spark, sf).agg(F.min("created_date"), F.max("created_date")).first()
    return cleaning.weekly_windows(spark, hi, (hi - lo).days, 7)


def _keyword_rows(keywords) -> str:
    return "k(pos, kw, city, region) AS (VALUES " + ", ".join(
        f"({i}, '{k}', '{c}', '{r}')" for i, (k, c, r) in enumerate(keywords)) + ")"


def _first_place(keywords) -> str:
    return f"""WITH p AS (SELECT doc_id, lower(text) AS t FROM documents), {_keyword_rows(keywords)}
SELECT doc_id, city, region FROM p LEFT JOIN (SELECT doc_id AS d, kw, city, region, row_number() OVER (PARTITION BY doc_id
 ORDER BY pos) AS rn FROM p JOIN k ON contains(t, kw)) h ON h.d = p.doc_id AND rn = 1"""


@query("infer_city", _first_place(places.CITY_KEYWORDS))
def _(spark, sf):
    return places.infer_city(A.table(spark, sf, "documents")).select("doc_id", "city", "region")


# The documents name none of the default places, so short words stand in as keywords.
WORDS = (("the", "Thetown", "North"), ("der", "Derby", "West"), ("que", "Quebec", "East"), ("les", "Lesotho", "South"),
         ("ing", "Ingolstadt", "West"), ("ent", "Entebbe", "East"))

@query("infer_city_keywords", _first_place(WORDS))
def _(spark, sf):
    return places.infer_city(A.table(spark, sf, "documents"), keywords=WORDS).select("doc_id", "city", "region")


@query("mart_entities", f"""WITH p AS (SELECT lower(text) AS t, CAST((doc_id % 9 - 4) AS DOUBLE) / 8.0 AS score FROM documents), {_keyword_rows(WORDS)}
SELECT city AS entity, 'city' AS etype, count(*) AS mentions, round(avg(score), 3) AS avg_score FROM p JOIN k ON contains(t, kw)
GROUP BY city""")
def _(spark, sf):
    docs = A.table(spark, sf, "documents").withColumn("score", (F.col("doc_id") % 9 - 4).cast("double") / 8.0)
    return marts.entities(places.extract_entities(docs, keywords=WORDS))
