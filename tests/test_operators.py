"""Operators on seeded tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxmart.config import Brand
from voxmart.operators import churn, facts, feed, issues, marts, quality, scd2, scoring, series, terms, worklists
from voxmart.schemas import align, empty
from voxmart.sources import imports, mappers, pages, store

D = dt.datetime


def ts(value):
    return F.lit(value).cast("timestamp")


# ---------------------------------------------------------------- dimensions and facts
POST = "source_id string, author string, author_name string, engagement bigint, view_count bigint, sentiment string, intent string, created_at timestamp"


def test_scd2_author(spark):
    bridge = spark.createDataFrame([("@ravi", "C1")], "author string, customer_key string")
    first = spark.createDataFrame([("1", "@ravi", None, 10, None, "negative", "complaint", D(2026, 7, 1)),
                                   ("2", "@bankcare", None, 99, None, "neutral", "other", D(2026, 7, 1))], POST)
    h1 = scd2.build_dim_author(empty(spark, "dim_author"), first, bridge, ts("2026-07-02"))
    assert [(r["author_key"], r["version"], r["is_customer"]) for r in h1.collect()] == [("@ravi#v1", 1, 1)]
    again = scd2.build_dim_author(h1, first, bridge, ts("2026-07-03"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, h1.collect()))
    more = first.unionByName(spark.createDataFrame([("3", "@ravi", "Ravi", 5000, None, "negative", "complaint", D(2026, 7, 4))], POST))
    h2 = {r["author_key"]: r for r in scd2.build_dim_author(h1, more, bridge, ts("2026-07-05")).collect()}
    assert (h2["@ravi#v1"]["is_current"], h2["@ravi#v2"]["influence_tier"], h2["@ravi#v2"]["complaint_count"]) == (0, "mid", 2)
    assert h2["@ravi#v1"]["effective_to"] == D(2026, 7, 5)


THREAD = "source_id string, conversation_id string, source string, author string, text string, created_at timestamp, score double, sentiment string"


def test_interactions(spark):
    rows = [("1", "c1", "twitter", "@ravi", "money stuck", D(2026, 7, 1, 10), -0.6, "negative"),
            ("2", "c1", "twitter", "@BankCare", "Refund initiated", D(2026, 7, 1, 11), 0.0, "neutral"),
            ("3", "c1", "twitter", "@ravi", "thanks", D(2026, 7, 1, 12), 0.8, "positive"),
            ("4", "c2", "twitter", "@x", "help", D(2026, 7, 1, 10), None, "neutral"),
            ("5", "c3", "twitter", "@bankcare", "notice", D(2026, 7, 1), 0.0, "neutral"),
            ("6", "c4", "twitter", "@y", "late", None, -0.1, "negative"), ("7", "c4", "twitter", "@bankcare", "sorry", D(2026, 7, 1), 0.0, "neutral")]
    got = {r["conversation_id"]: r for r in facts.fact_interaction(spark.createDataFrame(rows, THREAD)).collect()}
    assert set(got) == {"c1", "c2", "c4"}
    c1 = got["c1"]
    assert (c1["resolved"], c1["customer_satisfied"], c1["recovery_delta"], c1["response_latency_min"]) == (1, 1, 1.4, 60.0)
    assert (got["c2"]["resolution_type"], got["c2"]["resolved"], got["c2"]["customer_satisfied"]) == ("none", 0, None)
    assert (got["c4"]["resolution_type"], got["c4"]["customer_satisfied"], got["c4"]["response_latency_min"]) == ("apology", None, None)
    k = marts.kpis(spark.createDataFrame([("1", "complaint", "high", "negative")], "source_id string, intent string, urgency string, sentiment string"),
                   facts.fact_interaction(spark.createDataFrame(rows, THREAD))).first()
    assert (k["total_mentions"], k["resolved_count"], k["sentiment_recovery_rate"], k["median_response_latency_min"]) == (1, 1, 50.0, 60.0)


def test_fact_daily_keeps_null_groups_and_reconciles(spark):
    rows = spark.createDataFrame([(20260701, "news", None, None, "complaint", 1, 0), (20260701, "news", None, 0.5, "other", 0, 1),
                                  (None, "news", "positive", 1.0, "praise", 0, 0)],
                                 "date_key int, source_key string, sentiment string, score double, intent string, fraud_signal int, churn_risk int")
    out = facts.fact_daily(rows).collect()
    assert len(out) == 1 and (out[0]["mentions"], out[0]["avg_score"], out[0]["complaints"]) == (2, 0.5, 1)


def test_one_spike_is_one_anomaly(spark):
    rows = [(f"{d}-{i}", "upi", -0.5, D(2026, 7, d)) for d in range(1, 10) for i in range(12 if d == 9 else 1)]
    out = series.trends(spark.createDataFrame(rows, "source_id string, rbi_category string, score double, created_at timestamp"))
    assert [r["day"].day for r in out.filter("anomaly = 1").collect()] == [9]


def test_forecast(spark):
    daily = spark.createDataFrame([("up", dt.date(2026, 7, d), d) for d in (1, 2, 4)] + [("one", dt.date(2026, 7, 1), 5)], "category string, day date, mentions int")
    out = {(r["category"], r["horizon_day"].day): (r["predicted_mentions"], r["trend"]) for r in series.forecast(daily).collect()}
    fit = np.polyfit([0, 1, 2], [1, 2, 4], 1)
    assert out == {("up", 5 + h): (round(float(np.polyval(fit, 3 + h)), 1), "rising") for h in range(3)}


def test_half_split_handles_a_hot_minute(spark):
    rows = [("k", D(2026, 7, 1, 10, 0), float(i), f"{i:03d}") for i in range(7)] + [("k", D(2026, 7, 1, 10, 1), 100.0, "x"), ("k", None, 5.0, "n")]
    r = marts.half_split(spark.createDataFrame(rows, "key string, at timestamp, v double, id string"), "key", "at", "v", "id").first()
    assert (r["n_dated"], r["older"], r["recent"]) == (8, 1.5, (4 + 5 + 6 + 100) / 4)


# ---------------------------------------------------------------- feed
def frame(spark):
    rows = [("a", "branch", "negative", "twitter", 900, 700, 1, D(2026, 7, 1)), ("b", "scam", "negative", "reddit", 5, None, 1, D(2026, 7, 2)),
            ("c", None, "positive", "twitter", 50, 10, 0, D(2026, 6, 1)), ("d", "branch", "positive", "play", None, None, None, None),
            ("e", "praise", "neutral", "news", 0, 0, 0, D(2026, 6, 9))]
    return spark.createDataFrame(rows, "source_id string, issue_category string, sentiment string, source string, engagement bigint, "
                                       "retweet_count bigint, fraud_signal int, created_at timestamp")


@pytest.mark.parametrize("stack,ids", [
    ([], "abcde"), ([{"field": "Category", "op": "is", "value": "branch"}], "ad"), ([{"field": "Category", "op": "is not", "value": "branch"}], "bce"),
    ([{"field": "Source", "op": "is any of", "value": ["twitter", "play"]}], "acd"), ([{"field": "Likes", "op": feed.GE, "value": 50}], "ac"),
    ([{"field": "Likes", "op": "between", "value": (5, 900)}], "abc"), ([{"field": "Fraud flag", "op": "is", "value": "No"}], "cde"),
    ([{"field": "Category", "op": "is", "value": ""}], "abcde"), ([{"field": "Nope", "op": "is", "value": 1}], "abcde"),
    ([{"field": "Category", "op": "is", "value": "branch"}, {"field": "Sentiment", "op": "is", "value": "negative"}, {"field": "Reshares", "op": feed.GE, "value": 500}], "a")])
def test_filter_stack(spark, stack, ids):
    assert "".join(sorted(r["source_id"] for r in feed.apply_filters(frame(spark), stack).collect())) == ids


def test_filter_labels():
    shown = [feed.describe({"field": f, "op": o, "value": v}) for f, o, v in (
        ("Source", "is any of", ["a", "b"]), ("Likes", feed.GE, 50), ("Likes", "between", (5, 900)), ("Fraud flag", "is", "No"), ("Nope", "is", 1))]
    assert shown == ["Source is any of a, b", "Likes ≥ 50", "Likes between 5–900", "Fraud flag is No", ""]


def test_months_windows_and_sql_guard(spark):
    f = frame(spark)
    assert [r["month"].month for r in feed.month_options(f).collect()] == [7, 6]
    assert feed.within(f, ts("2026-07-02 12:00:00"), "1d").count() == 1 and feed.within(f, ts("2026-07-02"), None).count() == 5
    f.createOrReplaceTempView("frame")
    assert feed.read_only_sql(spark, "select * from frame").count() == 5
    for good in ("select 'a;b'", "select 'please update'", "select current_date() as load", "with x as (select 1 as a) select * from x;"):
        assert feed.read_only_sql(spark, good).count() == 1
    assert feed.read_only_sql(spark, "select id from range(1000)").count() == 1000
    for bad in ("", "drop table frame", "select 1; select 2", "with x as (select 1) delete from frame"):
        with pytest.raises(ValueError):
            feed.read_only_sql(spark, bad)


def test_filters_reach_the_scan(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "f"))
    df = feed.in_month(feed.apply_filters(spark.read.parquet(str(tmp_path / "f")), [{"field": "Sentiment", "op": "is", "value": "negative"}]), 2026, 7)
    plan = df.select("source_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "sentiment" in plan.split("PushedFilters")[1] and "created_at" in plan.split("PushedFilters")[1]
    assert "retweet_count" not in plan


# ---------------------------------------------------------------- refresh
@pytest.mark.parametrize("first,last,count,due", [
    (D(2026, 7, 1, 0), None, 0, True), (D(2026, 7, 1, 0), D(2026, 7, 1, 11), 3, False), (D(2026, 7, 1, 0), D(2026, 7, 1, 10), 3, True),
    (D(2026, 6, 30, 11), None, 0, False), (D(2026, 7, 1, 0), None, 12, False), (None, None, None, True)])
def test_refresh_policy(spark, first, last, count, due):
    posts = spark.createDataFrame([("p", "reddit", first, last, count)], "source_id string, source string, fetched_at timestamp, last_refreshed_at timestamp, refresh_count int")
    assert (worklists.refresh_due(posts, ts("2026-07-01 12:00:00")).count() == 1) is due


def test_coercion_of_model_output(spark):
    junk = '{"sentiment":"angry","score":9,"confidence":"x","emotion_intensity":"high","aspects":[{"aspect":"?"},"no"],"fraud_signal":true}'
    rows = spark.createDataFrame([(junk, ["p1"]), ('{"results":[{"score":1},{"score":2}]}', ["p2"]), ("no json", ["p3"])], "output string, ids array<string>")
    out = scoring.coerce_outputs(rows).collect()
    assert len(out) == 1  # two answers for one post cannot be told apart, so neither is used
    r = out[0]
    assert (r["source_id"], r["sentiment"], r["score"], r["confidence"], r["emotion_intensity"], r["fraud_signal"]) == ("p1", "neutral", 1.0, 0.5, 3, 1)
    assert r["aspects"][0]["aspect"] == "other"


def test_scorer_batches_survive_a_failure(spark):
    schema = spark.createDataFrame([], "source_id string, sentiment string").schema

    def scorer(batch):
        if any(r["source_id"] == "3" for r in batch):
            raise RuntimeError("down")
        return [{"source_id": r["source_id"], "sentiment": "negative"} for r in batch]

    posts = spark.createDataFrame([(str(i),) for i in range(10)], "source_id string").coalesce(1)
    got = scoring.score_batches(posts, scorer, schema, batch=2)
    assert sorted(r["source_id"] for r in got.collect()) == sorted(str(i) for i in range(10) if i not in (2, 3))
    bad = scoring.score_or_refuse(posts, scorer, schema, batch=2).filter("error IS NOT NULL").collect()
    assert sorted((r["source_id"], r["sentiment"], r["error"]) for r in bad) == [("2", None, "RuntimeError: down"), ("3", None, "RuntimeError: down")]
    quiet = scoring.score_or_refuse(posts, lambda batch: scorer(batch[:1]), schema, batch=3).filter("error = 'left out of the answer'")
    assert {r["source_id"] for r in quiet.collect()} == {"1", "2", "7", "8"}


# ---------------------------------------------------------------- issues
def brute_force(ids, vectors, distance):
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dots, groups = x @ x.T, [[i] for i in range(len(ids))]
    while True:
        best = max(((dots[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(0, 0, 0))
        if not best[0] > 1 - distance:
            return {frozenset(ids[k] for k in g) for g in groups}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("component", [0, 8, 2048])
def test_average_linkage_equals_brute_force(spark, component):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 40)] + rng.normal(scale=0.55, size=(40, 8))
    x[7] = x[3]
    ids = [f"p{i:02d}" for i in range(40)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "source_id string, embedding array<double>")
    got = issues.cluster(df, distance=0.35, chunk=7, pivots=4, component=component).toPandas()
    assert {frozenset(g) for g in got.groupby("cluster").source_id.apply(list)} == brute_force(ids, x, 0.35)


def dense_tfidf(texts):
    import re

    words = [[w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in terms.STOP] for t in texts]
    names = sorted({w for ws in words for w in ws})
    tf = np.array([[ws.count(n) for n in names] for ws in words], float).reshape(len(texts), -1)
    x = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def sparse_case(seed, n=60):
    """Short texts of few words, with copies, edited copies, stop words only and nothing at all."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i:02d}" for i in range(30)] + ["the", "and", "Über"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 9), p=np.array([1 / (k + 3) for k in range(33)]) / sum(1 / (k + 3) for k in range(33))))
             for _ in range(n)]
    texts[5], texts[6], texts[7], texts[8], texts[9] = texts[4], texts[4] + " w29", None, "", "the and"
    return [f"p{i:02d}" for i in range(n)], texts


@pytest.mark.parametrize("component,limit", [(0, 3), (8, 64), (2048, 64), (2048, 1)])
def test_sparse_average_linkage_equals_brute_force(spark, component, limit):
    ids, texts = sparse_case(component + limit)
    df = spark.createDataFrame(list(zip(ids, texts)), "source_id string, text string").repartition(3)
    got = issues.cluster(terms.term_vectors(df), distance=0.35, chunk=16, component=component, limit=limit).toPandas()
    x = dense_tfidf(texts)
    none = ~x.any(1)
    wide = np.hstack([x, np.eye(len(ids))[:, none]])  # texts without terms: an axis of their own
    assert {frozenset(g) for g in got.groupby("cluster").source_id.apply(list)} == brute_force(ids, wide, 0.35)


@pytest.mark.parametrize("many", [0, 3, 256])
def test_sparse_vectors_above_a_threshold_are_found_exactly(monkeypatch, many):
    monkeypatch.setattr(terms, "MANY", many)
    monkeypatch.setattr(terms, "PRODUCTS", 50)
    rng = np.random.default_rng(many)
    dense = rng.random((60, 40)) * (rng.random((60, 40)) < np.linspace(0.02, 0.95, 40))
    dense[20:30] = dense[20] + 0.01 * rng.random((10, 40)) * (dense[20] > 0)
    dense[5] = 0
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    ids, weights = [np.flatnonzero(v) for v in dense], [v[v > 0] for v in dense]
    held = terms.Held(ids[10:], weights[10:])
    want = np.round(dense[:25] @ dense[10:].T, 12)
    assert np.allclose(terms.dots(ids[:25], weights[:25], ids[10:], weights[10:]), want)
    for threshold in (0.3, 0.65, 0.9):
        a, b, dot = held.above(ids[:25], weights[:25], threshold)
        assert sorted(zip(a, b)) == sorted(zip(*np.nonzero(want > threshold))) and np.allclose(dot, want[a, b])
    none = terms.Held([], [])
    assert not len(none.above(ids, weights, 0.3)[0]) and not len(held.above([], [], 0.3)[0])


def test_the_length_of_a_term_vector_is_computed_once(spark):
    rows = spark.createDataFrame([("a", "one two two"), ("b", "two three")], "source_id string, text string")
    plan = terms.term_vectors(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt(aggregate(") == 1 and "_n" in plan.split("transform(", 1)[1].split("\n", 1)[0]


@pytest.mark.parametrize("limit", [1, 4, 64])
def test_sparse_neighbours_are_all_found(spark, limit):
    ids, texts = sparse_case(5, 90)
    v = terms.term_vectors(spark.createDataFrame(list(zip(ids, texts)), "cid string, text string"), key="cid").withColumn("size", F.lit(1).cast("long"))
    v = terms.cut_lineage(v.select("cid", "size", "ids", "mean"), "case")
    some = v.filter("cid < 'p40'")
    dots = np.round(dense_tfidf(texts) @ dense_tfidf(texts).T, 9)
    np.fill_diagonal(dots, 0)
    want = {i: (ids[int(dots[k].argmax())], dots[k].max()) for k, i in enumerate(ids[:40]) if dots[k].max() > 0.3}
    got = issues.nearest_neighbours(v, some, 0.3, chunk=8, edge=terms.frequent_from(v, limit)).collect()
    assert {r.cid: round(r["dot"], 9) for r in got} == {k: x for k, (_, x) in want.items()} and len(want) > 20
    assert all(dots[ids.index(r.cid), ids.index(r.nn)] == round(r["dot"], 9) for r in got)


def test_cells_are_split_until_they_fit(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(scale=0.05, size=(200, 4)) + c for c in (np.eye(4)[0], np.eye(4)[1])])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i}", 1, v.tolist()) for i, v in enumerate(x)], "cid string, size bigint, mean array<double>")
    placed, stats = issues._cells(df, 12, 4, 400)
    assert max(n for _, n, _ in stats.values()) <= 12 and sum(n for _, n, _ in stats.values()) == 400
    rows = placed.collect()
    assert all(abs(np.linalg.norm(np.array(r["mean"]) - stats[r["cell"]][0]) - r["gap"]) < 1e-6 for r in rows)
    dots = np.round(x @ x.T, 12)
    np.fill_diagonal(dots, -1)
    got = {r.cid: r["dot"] for r in issues.nearest_neighbours(df, df, 0.9, chunk=12, pivots=4).collect()}
    assert {f"v{i}": m for i, m in enumerate(dots.max(1)) if m > 0.9}.keys() == got.keys()
    assert all(abs(got[f"v{i}"] - dots[i].max()) < 1e-9 for i in range(400) if f"v{i}" in got)


def test_issues_from_text(spark):
    said = ["upi payment failed today", "upi payment failed again", "payment failed upi", "lovely branch staff", "lovely staff branch"]
    rows = spark.createDataFrame([(str(i), t, D(2026, 7, 1), -0.5, "", t, "cards") for i, t in enumerate(said)],
                                 "source_id string, text string, created_at timestamp, score double, theme string, summary string, recommended_team string")
    found = issues.number_clusters(issues.cluster(terms.term_vectors(rows), distance=0.6))
    top = issues.ranked(issues.profile(rows.join(found, "source_id")))
    r = top.first()
    assert (r["cluster_id"], r["size"], r["emerging"], r["title"]) == (0, 3, True, said[0])


def test_churn_regression_is_the_stated_objective(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(1, 20, 60), rng.integers(0, 5, 60), rng.uniform(-1, 1, 60), rng.uniform(0, 1, 60)]).astype(float)
    y = ((x[:, 3] + rng.normal(scale=0.4, size=60)) > 0.7).astype(int)
    df = spark.createDataFrame([(f"@{i}", int(r[0]), int(r[1]), int(0), float(r[2]), float(r[3]), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                               "author string, mentions int, complaints int, churn_threat int, avg_score double, neg_ratio double, churn_flag int")
    got = churn.with_probability(df).toPandas().set_index("author")["prob"]
    w = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    z, beta = np.column_stack([x, np.ones(60)]), np.zeros(5)
    for _ in range(200):  # Newton on 0.5 |b|^2 + sum w * logloss, free intercept
        p = 1 / (1 + np.exp(-z @ beta))
        reg = np.diag([1, 1, 1, 1, 0.0])
        beta -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + reg, z.T @ (w * (p - y)) + reg @ beta)
    want = pd.Series(1 / (1 + np.exp(-z @ beta)), index=[f"@{i}" for i in range(60)])
    assert np.allclose(got.loc[want.index], want, atol=1e-3)


# ---------------------------------------------------------------- store, gate, audit
def test_publish_only_what_passes(spark, tmp_path):
    w = store.Warehouse(spark, str(tmp_path / "wh"))
    good = spark.createDataFrame([(1,), (2,)], "id int")
    assert w.publish("1", quality.unique(w.write("t", good, "1"), "t", "id"))
    assert not w.publish("2", quality.unique(w.write("t", good.union(good), "2"), "t", "id"))
    assert w.current() == "1" and w.read("t").count() == 2
    assert w.publish("3", quality.not_null(w.write("t", good.limit(1), "3"), "t", "id")) and w.read("t").count() == 1


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "k string, i int, v int")
    new = spark.createDataFrame([("a", 1, 9), ("a", 2, 7)], "k string, i int, v int")
    assert sorted(map(tuple, store.upsert(old, new, ["k", "i"]).collect())) == [("a", 1, 9), ("a", 2, 7), ("b", 1, 6)]
    half = spark.createDataFrame([("a", None), ("b", 8)], "k string, v int")
    assert sorted(map(tuple, store.patch(old, half, "k", ["v"]).collect())) == [("a", 1, 5), ("b", 1, 8)]
    wide = align(spark.createDataFrame([("x", float("nan"))], "source_id string, score double"), "analysis").first()
    assert wide["score"] is None and wide["aspects"] is None


def test_last_occurrence_wins(spark):
    a = spark.createDataFrame([("x", "old"), ("y", "")], "source_id string, text string")
    b = spark.createDataFrame([("x", "new")], "source_id string, text string")
    assert [(r["source_id"], r["text"]) for r in store.one_per_post(store.union_sources([a, b])).collect()] == [("x", "new")]


# ---------------------------------------------------------------- sources
def test_csv_import(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "# demo export\n# two notes\nfull_text,username,id_str,date,likes\n"
        '"acme bank, is down",ravi,1234567890123,2026-07-01,"1,200"\n#acmebank hashtag first,@z,1234567890124,bad date,5\n'
        ",q,1234567890125,2026-07-01,1\nacme short id,q,12,2026-07-01,1\nzeta bank,q,1234567890126,2026-07-01,1\n")
    rows = imports.triaged(imports.read_csv(spark, str(tmp_path / "x.csv")))
    assert {r["reason"]: r["rows"] for r in imports.refused(rows).collect()} == {"empty": 1, "untraceable": 1, "off-brand": 1}
    good = {r["source_id"]: r for r in imports.imported(rows).collect()}
    assert (good["x:1234567890123"]["author"], good["x:1234567890123"]["engagement"]) == ("@ravi", 1200)
    other = good["x:1234567890124"]
    assert other["text"].startswith("#acmebank") and other["created_at"] is None and other["raw_created_at"] == "bad date"


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    (folder / "a.csv").write_text("# note\n" * 500 + 'text,id\n"two\nlines, ""quoted""",1\n# note,2\n\n', newline="")
    (folder / "b.csv").write_text("\ufeffid,likes,,text\r\n3,7,x,b\r\n4,8\r\n", newline="")
    (folder / "c.csv").write_text("# only notes\n")
    (folder / "d.csv").write_text("")
    got = {r["id"]: (r["text"], r["likes"], r["column_2"]) for r in imports.read_csv(spark, str(folder)).collect()}
    assert got == {"1": ('two\nlines, "quoted"', None, None), "2": ("# note", None, None), "3": ("b", "7", "x"), "4": (None, "8", None)}
    assert [r["file"].rsplit("/", 1)[1] for r in imports.unread_files(spark, str(folder)).collect()] == ["c.csv"]


@pytest.fixture()
def tiny_ranges(spark):
    """Scans cut into ranges of a few bytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("longest", [1 << 20, 12])
def test_csv_in_ranges_reads_what_a_reader_of_whole_files_does(spark, tmp_path, tiny_ranges, longest):
    """Quotes in all places, line breaks of all kinds in and out of quotes, comments longer than a range, an unclosed quote."""
    import csv
    import io
    import random

    rng = random.Random(longest)
    cells = ["a", "", "5\" wide", '"x, y"', '"two\nlines"', '"say ""hi"""', '""', '"a\r\nb"', '"\n"', "# no note", ' "b"', '"c"d"', "ü🙂", '"' + "long text\n" * 12 + '"']
    want = []
    for f in range(12):
        names = rng.sample(["id", "text", "likes", "Date"], 3)
        body = "".join(",".join(rng.choice(cells[: 99 if f % 4 == 2 else -1]) for _ in range(rng.randrange(1, 5))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(30))
        if f % 4 == 3:
            body += 'x,"never closed\nto the end,'
        table = ",".join(names) + "\n" + body
        (tmp_path / f"f{f}.csv").write_text("\ufeff" * (f % 2) + '# a "note\n\n' * (12 * (f % 3)) + table, newline="", encoding="utf-8")
        rows = [r for r in csv.reader(io.StringIO(body, newline="")) if r]
        want += [tuple(dict(zip(names, r)).get(n) for n in ("Date", "id", "likes", "text")) for r in rows]
    got = imports.read_csv(spark, str(tmp_path), longest)
    assert got.columns == ["Date", "id", "likes", "text"] and got.rdd.getNumPartitions() > 50
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kinds = {r["kind"] for r in imports.csv_plan(spark, str(tmp_path), longest)[0].collect()}
    assert kinds >= ({"skip", "first", "header", "inside", "record", "whole"} if longest > 12 else {"whole"})


def test_card_parser(spark):
    html = ("<div class='complaint-box-results'><a class='complaint-box-results__title' href='/x-c12'>Acme <b>bad</b></a><div>"
            "<span class='complaint-box-results__text'>It was&nbsp;slow <br>very</span></div></div><p>acme outside</p>"
            "<div class='complaint-box-results'><a class='complaint-box-results__title' href='/no-id'>Acme</a></div>")
    got = pages.complaints(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [(r["source_id"], r["text"]) for r in got] == [("consumercomplaints:12", "Acme bad. It was slow very")]


def test_thread_gate_needs_share_and_count(spark):
    rows = [("a", i, i < 3) for i in range(10)] + [("b", i, i < 3) for i in range(11)] + [("c", i, i < 2) for i in range(4)]
    kept = mappers.thread_gate(spark.createDataFrame(rows, "t string, i int, n boolean"), "t", F.col("n")).groupBy("t").count()
    assert {r["t"]: r["count"] for r in kept.collect()} == {"a": 10, "b": 3, "c": 2}


def test_share_of_voice_sums_to_100(spark):
    own = spark.createDataFrame([("negative", 0.1)] * 3, "sentiment string, score double")
    other = spark.createDataFrame([("B", "positive", 0.5), ("C", "neutral", 0.0)], "brand string, sentiment string, score double")
    out = marts.share_of_voice(own, other, Brand(name="A")).collect()
    assert sum(r["share_of_voice"] for r in out) == pytest.approx(100) and {r["brand"] for r in out} == {"A", "B", "C"}


def test_discourse_topics_are_looked_up_in_the_payload(spark):
    """No join: a wrong estimate made all topics a broadcast."""
    import json

    from voxmart.sources import mappers
    page = json.dumps({"posts": [{"id": "1", "topic_id": 7, "blurb": "a"}, {"id": "2", "topic_id": 9, "blurb": "b"}, {"id": "3", "blurb": "c"}],
                       "topics": [{"id": 7, "title": "A", "slug": "a"}, {"id": 7, "title": "B", "slug": "b"}, {"title": "none"}]})
    other = json.dumps({"posts": [{"id": "4", "topic_id": 7, "blurb": "d"}]})
    df = spark.createDataFrame([(page,), (page,), (other,), ("no json",), (None,)], "payload string")
    got = mappers.discourse_posts(df, gate=False)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["source_id"]: (r["text"], r["url"].split("/t/")[1]) for r in got.collect()} == {
        "valuepickr:1": ("B. a", "b/7/1"), "valuepickr:2": ("b", "t/9/1"), "valuepickr:3": ("c", "t/1"), "valuepickr:4": ("d", "t/7/1")}


def test_cards_come_out_in_small_batches(spark, monkeypatch):
    """One page with more cards than a batch; before, all cards of all pages that came in at once were one frame."""
    from voxmart.sources import pages
    assert pages.BATCH <= 5000
    card = "<div class='place-card'><a class='place-name'>n{}</a><span class='place-rating'>4</span></div>"
    df = spark.createDataFrame([("u", "".join(card.format(i) for i in range(2 * pages.BATCH + 5))), ("v", None), (None, card.format("x"))], "url string, html string")
    sized = pages.cards(df, pages.BRANCH_CARDS).mapInArrow(lambda batches: batches, "url string, pos int, fields map<string,string>")
    rows = sized.collect()
    assert len(rows) == 2 * pages.BATCH + 6
    assert {r["pos"]: r["fields"] for r in rows if r["url"] == "u"}[pages.BATCH] == {"title": f"n{pages.BATCH}", "stars": "4"}
    assert "PythonMapInArrow" in pages.cards(df, pages.BRANCH_CARDS)._jdf.queryExecution().optimizedPlan().toString() or \
        "MapInArrow" in pages.cards(df, pages.BRANCH_CARDS)._jdf.queryExecution().optimizedPlan().toString()


def test_assign_asks_once_for_equal_vectors(spark, monkeypatch):
    from voxmart.operators import issues
    asked = []
    real = issues.nearest_neighbours
    monkeypatch.setattr(issues, "nearest_neighbours", lambda held, asking, *a, **k: asked.append((held.count(), asking.count())) or real(held, asking, *a, **k))
    known = spark.createDataFrame([(f"k{i}", [1.0, 0.0], "A") for i in range(30)] + [("z", [0.0, 1.0], "B")], "source_id string, embedding array<double>, cluster string")
    new = spark.createDataFrame([(f"n{i}", [2.0, 0.0]) for i in range(40)] + [("k0", [1.0, 0.0]), ("z", [0.0, 1.0]), ("far", [-1.0, -1.0])], "source_id string, embedding array<double>")
    got = {r["source_id"]: r["cluster"] for r in issues.assign(new, known).collect()}
    assert asked == [(3, 4)]
    assert got == {**{f"n{i}": "A" for i in range(40)}, "k0": "A", "z": "z", "far": "far"}


def test_places_sort_narrow_rows_without_moving_ranges(spark):
    from voxmart.operators import feed
    rows = spark.createDataFrame([(f"s{i:02}", i % 3 if i % 4 else None) for i in range(20)], "source_id string, engagement bigint")
    out = feed.places(rows, "Likes")
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(((r[0], r[1]) for r in rows.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["source_id"] for r in out.orderBy("place").collect()] == [r[0] for r in want]


def test_csv_import_writes_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from voxmart.plans import catalog_sources as c
    from voxmart.plans import registry
    spark.createDataFrame([(i, f"Acme text {i} " * 5) for i in range(200)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query, seen = registry.load()[0]["csv_import"], []
    real = c.imports.read_csv
    monkeypatch.setattr(c.imports, "read_csv", lambda s, path: seen.append(path) or real(s, path))
    one = sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=str)
    monkeypatch.setattr(c, "FILE_BYTES", 500)
    many = sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=str)
    assert one == many
    files = [spark.read.text(p).inputFiles() for p in seen]
    assert len(files[0]) == 4 and len(files[1]) > 8


def test_fresh_feeds_reads_items_once(spark):
    from pyspark.sql import functions as F

    from voxmart.sources import mappers
    items = spark.createDataFrame([("a", "2024-01-05 10:00:00"), ("a", "2020-01-05 10:00:00"), ("b", "2020-01-05 10:00:00"), ("c", None)], "feed string, published string")
    marked = items.withColumn("mark", F.md5("feed"))
    got = mappers.fresh_feeds(marked, F.lit("2024-01-06").cast("timestamp"), 30)
    assert "md5(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["published"] for r in got.collect()) == ["2020-01-05 10:00:00", "2024-01-05 10:00:00"]


def test_dense_neighbours_where_cells_do_not_help(spark, monkeypatch):
    monkeypatch.setattr(issues, "CELLS", 64)
    monkeypatch.setattr(issues, "NEAR", 2)
    x = np.random.default_rng(2).normal(size=(60, 5))
    x[40:44] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"v{i:02d}" for i in range(60)]
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in zip(ids, x)], "cid string, size bigint, mean array<double>")
    dots = np.round(x @ x.T, 12)
    np.fill_diagonal(dots, -1)
    found = issues.nearest_neighbours(df, df, 0.0, chunk=16, pivots=4)
    assert "visit" not in found._jdf.queryExecution().analyzed().toString()
    assert {r.cid: r.nn for r in found.collect()} == {i: ids[int(row.argmax())] for i, row in zip(ids, dots) if row.max() > 0}


@pytest.mark.parametrize("chained", [0, 1 << 22])
def test_large_components_are_merged_alike_by_chains_and_rounds(spark, chained):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(3, 8)), 20, axis=0) + rng.normal(scale=0.5, size=(60, 8))
    ids = [f"p{i:02d}" for i in range(60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "source_id string, embedding array<double>")
    got = issues.cluster(df, distance=0.35, component=4, chained=chained).toPandas()
    assert {frozenset(g) for g in got.groupby("cluster").source_id.apply(list)} == brute_force(ids, x, 0.35)


def test_large_components_of_sparse_vectors_are_merged_without_rounds(spark, monkeypatch):
    ids, texts = sparse_case(11)
    vectors = terms.term_vectors(spark.createDataFrame(list(zip(ids, texts)), "source_id string, text string").repartition(3))
    found = []
    for chained in (1 << 22, 0):
        got = issues.cluster(vectors, distance=0.5, component=4, chained=chained).toPandas()
        found.append({frozenset(g) for g in got.groupby("cluster").source_id.apply(list)})
    x = dense_tfidf(texts)
    wide = np.hstack([x, np.eye(len(ids))[:, ~x.any(1)]])
    assert found[0] == found[1] == brute_force(ids, wide, 0.5) and max(map(len, found[0])) > 4

    def rounds(*_):
        raise AssertionError("a component that fits a task was merged in rounds")
    monkeypatch.setattr(issues, "nearest_neighbours", rounds)
    issues.cluster(vectors, distance=0.5, component=4)


def test_means_of_merged_sparse_clusters():
    rng = np.random.default_rng(3)
    x = rng.random((12, 30)) * (rng.random((12, 30)) < 0.3)
    x[4] = 0
    means = terms.Means([np.flatnonzero(r) for r in x], [r[r > 0] for r in x])
    size, out = rng.integers(1, 4, 12).astype(float), []
    for i, j in ((0, 3), (0, 7), (2, 4), (0, 2)):
        means.merge(i, j, size)
        x[i] = (x[i] * size[i] + x[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        out.append(j)
        others = np.setdiff1d(np.arange(12), [i, *out])
        assert np.allclose(means.dots(i)[others], (x @ x[i])[others])
    left = np.array([0, 1, 5, 8, 9])
    means.keep(left)
    for k, i in enumerate(left):
        assert np.allclose(np.delete(means.dots(k), k), np.delete(x[left] @ x[i], k))


def test_rows_and_columns_stay_connected_by_fewer_places():
    near = np.random.default_rng(4).random((30, 40)) < 0.03
    x, y = issues._spanning(near)
    assert near[x, y].all() and set(y) == set(np.flatnonzero(near.any(0)))

    def groups(x, y):
        label = {n: n for n in [("r", i) for i in x] + [("c", j) for j in y]}
        for _ in range(80):
            for i, j in zip(x, y):
                label[("r", i)] = label[("c", j)] = min(label[("r", i)], label[("c", j)])
        return label
    assert groups(x.tolist(), y.tolist()) == groups(*(v.tolist() for v in np.nonzero(near)))


def test_task_functions_of_the_clustering_need_no_package(spark):
    from pyspark import cloudpickle

    for function in (issues._dots, issues._nearest, issues._spanning, terms.Held):
        assert b"voxmart.session" not in cloudpickle.dumps(function) and b"voxmart.sources" not in cloudpickle.dumps(function)


def test_texts_of_one_key_are_one_text(spark):
    rows = [("a", "one two"), ("b", "one two two three"), ("a", "two three"), (None, "four five"), (None, "five"), ("c", None), ("d", "four five five")]
    got = {r["cid"]: (r["ids"], [round(x, 9) for x in r["mean"]]) for r in terms.term_vectors(
        spark.createDataFrame(rows, "cid string, text string").repartition(4), key="cid").collect()}
    assert got["a"] == got["b"] and got[None] == got["d"] and got["c"] == ([], []) and len(got) == 5
    w = np.array([1 * np.log(5 / 3) + 1, 1 * np.log(5 / 3) + 1, 2 * (np.log(5 / 3) + 1)])  # 4 keys that are not null; each term has two texts
    assert np.allclose(sorted(got["a"][1]), sorted(w / np.linalg.norm(w)))


def test_sparse_blocks_meet_without_copies(spark, monkeypatch):
    ids, texts = sparse_case(3, 90)
    v = terms.term_vectors(spark.createDataFrame(list(zip(ids, texts)), "cid string, text string"), key="cid").withColumn("size", F.lit(1).cast("long"))
    plans, counts, real = {}, {}, terms.cut_lineage

    def noted(df, name, *a, **k):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        out = real(df, name, *a, **k)
        counts[name] = sum(len(r["cids"]) for r in out.collect()) if name == "blocks" else 0
        return out
    monkeypatch.setattr(terms, "cut_lineage", noted)
    found = issues.nearest_neighbours(v, v, 0.3, chunk=4, edge=terms.frequent_from(v))
    assert "CartesianProduct" in plans["met"] and "Exchange" not in plans["met"] and counts["blocks"] == 90
    dots = np.round(dense_tfidf(texts) @ dense_tfidf(texts).T, 9)
    np.fill_diagonal(dots, 0)
    assert {r.cid: round(r["dot"], 9) for r in found.collect()} == {i: dots[k].max() for k, i in enumerate(ids) if dots[k].max() > 0.3}


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from voxmart import session
    before = spark.conf.get(session.CLEANUP)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle")}
    was = held()
    out = session.cut_lineage(spark.range(1000).repartition(5, "id"), "moved")
    for _ in range(100):
        if not (more := held() - was):
            break
        time.sleep(0.1)
    assert not more and spark.conf.get(session.CLEANUP) == before and out.count() == 1000


def kept_tables(spark):
    """Names of the intermediate tables that are there now."""
    import collections
    import os

    from voxmart.session import scratch_root
    root = scratch_root(spark).removeprefix("file:")
    return collections.Counter(n.rsplit("-", 1)[0] for n in os.listdir(root)) if os.path.isdir(root) else collections.Counter()


def test_clustering_keeps_vectors_once(spark):
    ids, texts = sparse_case(2)
    before = kept_tables(spark)
    vectors = terms.term_vectors(spark.createDataFrame(list(zip(ids, texts)), "source_id string, text string"))
    got = issues.cluster(vectors, distance=0.35).toPandas()
    more = kept_tables(spark) - before
    assert more["weights"] == 1 and not more.keys() & {"batches", "vocabulary", "vectors", "first", "blocks", "placed", "merged"}
    x = dense_tfidf(texts)
    wide = np.hstack([x, np.eye(len(ids))[:, ~x.any(1)]])
    assert {frozenset(g) for g in got.groupby("cluster").source_id.apply(list)} == brute_force(ids, wide, 0.35)


def test_rounds_of_a_clustering_leave_no_tables(spark):
    ids, texts = sparse_case(2)
    before = kept_tables(spark)
    vectors = terms.term_vectors(spark.createDataFrame(list(zip(ids, texts)), "source_id string, text string"))
    got = issues.cluster(vectors, distance=0.35, component=0, chained=0).toPandas()
    more = kept_tables(spark) - before
    assert more["met"] > 3 and max(more["alive"], more["neighbours"], more["pairs"]) <= 2 and more["member"] == 1
    x = dense_tfidf(texts)
    wide = np.hstack([x, np.eye(len(ids))[:, ~x.any(1)]])
    assert {frozenset(g) for g in got.groupby("cluster").source_id.apply(list)} == brute_force(ids, wide, 0.35)
