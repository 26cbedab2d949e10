"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of local[n] (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline list)
BENCH_REPEAT   timed runs per query, the fastest counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time

from obsgauge import build_session
from obsgauge.plans.registry import QUERIES

HEADLINE = [
    "rule_res_005", "rule_log_001", "rule_met_005", "rule_spa_004", "attr_cardinality", "mergeable_cardinality",
    "two_generation_max", "resource_attr_cardinality", "trace_health", "service_dependency", "service_score",
    "item_evidence", "graph_nodes", "series_key", "price_lines", "cost_trend", "presence_segments", "windowed_ratio",
    "replay_firings", "burn_rate", "scorecard", "robust_stats", "propose_thresholds", "run_continuity",
    "entity_breakdown", "entity_jaccard", "bench_summary", "normalize_diagnosis",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = build_session(f"local[{cpus}]", app="bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)  # warm-up: code generation and file listing
        seconds[name] = round(min(run(spark, name, folder) for _ in range(repeat)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus), "driver_memory": "16g"}))


if __name__ == "__main__":
    main()
