"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    # cleaning and masking over whole texts
    "clean_posts", "duplicates", "pii_masked", "page_text", "content_blocklist",
    # scoring and rules
    "lexicon_sentiment", "baseline_analysis", "issue_category", "brand_gates", "model_output_coercion",
    # facts and dimensions
    "fact_mention", "fact_interaction", "fact_daily", "dim_author_scd2", "vw_mention",
    # marts and series
    "mart_channel", "mart_rm_enablement", "mart_admin_analytics", "mart_kpis", "part_scorecard", "mart_influencers",
    "trends", "mart_forecast", "mart_competitor_sov", "half_split_trend", "preset_counts", "mart_churn_risk",
    # reads
    "triage_feed", "priority_queue", "team_worklist", "filter_stack", "search_mentions",
    # sources, merges, clustering, streaming
    "tweet_mapper", "complaint_cards", "upsert_replace", "nearest_neighbours", "issue_clusters", "stream_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from voxmart.plans import registry
    from voxmart.session import build_session, clear_scratch

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = registry.load()
    only = [a for a in sys.argv[1:] if a in queries]
    queries["fact_daily"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
