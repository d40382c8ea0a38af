"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON. Each query runs once to warm up, then counts by the best of two runs."""

from __future__ import annotations

import json
import os
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
QUERIES = [
    "pricing_summary", "match_gte_lt", "sort_limit", "group_having", "acc_first", "acc_push", "lookup", "lookup_unwind", "lookup_size", "lookup_several", "lookup_pipeline", "unwind", "bucket_auto",
    "facet", "window_sum_running", "window_top_per_group", "graph_lookup_depth0", "expr_map", "pipe_revenue_by_region", "pipe_customer_tiers", "pipe_event_funnel", "pipe_top_parts", "pipe_conversations",
]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pipeloom import queries

    known, took, compiled = queries.queries(), {}, {}
    for name in QUERIES:
        best = None
        for i in range(3):
            began = time.perf_counter()
            df = known[name](spark, SF)
            ready = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            ended = time.perf_counter()
            if i and (best is None or ended - began < best):
                best, compiled[name] = ended - began, ready - began
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "compile_sec": {k: round(v, 4) for k, v in compiled.items()}, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
