"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.plans.catalog import all_queries  # noqa: E402
from newsloom.session import build_session  # noqa: E402

HEADLINE = (
    "f02_tokenize", "f14_dictionary_entities", "f26_item_features",
    "d01_normalize_url", "d07_drop_known", "d08_unique_in_batch",
    "s02_json_items", "s04_feed_items", "s06_page_profile", "s09_feed_documents",
    "t01_similar_titles", "t05_join_decision", "t07_cluster_assignments", "t09_thread_rollup",
    "t18_momentum", "t19_thread_profile", "t21_thread_list_by_hotness",
    "q01_item_page", "q02_phrase_search", "q02_phrase_search_indexed",
    "a05_filled_week", "a06_top_sources", "x05_event_sequence", "x08_streaks", "x10_source_health",
    "r05_affinity_fold", "r08_recommendations", "r20_win_rate", "l05_budget_breaker_audit",
    "d10_stream_dedup", "x17_live_monitor",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = tuple(sys.argv[1:]) or HEADLINE
    spark = build_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["a04_daily_items"](spark, folder).count()  # start the JVM and the Python workers
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
