"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = os.environ.get("BENCH_ONLY", "").split() or [
    "d1_bars_1m", "d2_bars_covered", "e20_coverage_runs", "d5_continuity", "a8_manifest", "a13_parse_feed",
    "e12_features_15m", "c1_asof_daily", "c8_excursions", "k3_trades", "k7_walk_forward",
    "d6_scorecard", "d9_study_stats", "d10_metrics", "e28_rolling_bounds", "t6_bench_states",
    "c11_fifo_total", "e36_average_cost", "c19_reconcile", "d32_order_executions", "a15_latest_executions",
    "b10_entry_risk", "d28_sentiment", "h19_audit_chain", "t4_candles",
]


def main() -> None:
    from tapeworks.plans.catalog import QUERIES
    from tapeworks.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(cpus, "tapeworks-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # JVM warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
