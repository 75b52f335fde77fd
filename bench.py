"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

from storyline.plans import load_all
from storyline.plans.registry import QUERIES
from storyline.session import build_session

HEADLINE = (
    "p4_normalize_url", "p13_normalize_item", "c1_classify", "d1_duplicate_lookup", "f2_search", "w3_keyset_page",
    "a3_source_balance", "a7_weekly_candidates", "j1_candidate_window", "w9_message_context", "s1_feed_items",
    "s7_page_articles", "j2_similar_articles_with_sequence", "p12_source_artifacts", "d2_greedy_first_wins", "d4_visible_updates",
    "a8_feature_rollup", "g9_outliers", "g10_story_graph", "w2_weekly_selection", "t1_stream_ingest",
    "g6_online_assignment_with_sequence", "g7_story_merge_score", "g11_maintenance_pass",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = os.environ.get("BENCH_ONLY")
    load_all()
    spark = build_session(f"local[{cpus}]", app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings = {}
    for name in HEADLINE:
        if only and name not in only.split(","):
            continue
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
