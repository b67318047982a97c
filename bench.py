"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned and run to completion into Spark's no-op sink
(nothing is collected); the median of BENCH_RUNS runs is reported after one
warm-up run on the smallest scale. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["build_index", "bm25_topk", "cosine_topk", "hybrid_search", "near_pairs",
            "consolidate_classify", "consolidate_fold"]


def run(fn, spark, sf_dir) -> float:
    t = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    from quire.plans.catalog import QUERIES
    from quire.session import build_session
    spark = build_session(app_name="quire-bench")
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for n in names:
            run(QUERIES[n], spark, warm)
    out = {}
    for n in names:
        times = [run(QUERIES[n], spark, sf_dir) for _ in range(runs)]
        out[n] = round(statistics.median(times), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_sec", "value": round(sum(out.values()), 3), "unit": "sec",
        "queries": out, "sf": float(m.group(1)) if m else None, "runs": runs,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
