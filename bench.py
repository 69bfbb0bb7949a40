"""Benchmark the headline queries.

Runs each query fully (``noop`` sink: every row computed, nothing collected)
once to warm up and then ``BENCH_RUNS`` times; reports the median per query
and their sum as one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma list; default the headline set).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("clean_text", "process_pages", "table_cells", "code_blocks", "document_quality", "corpus_summary",
            "rate_flag", "latency_histogram", "worklist_route", "sprint_metrics")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from pagemill.plans.catalog import QUERIES
    from pagemill.session import get_session

    spark = get_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus * 2),
        "spark.driver.memory": "16g",
        "spark.pagemill.parsePartitions": str(cpus),  # the tables are single files
    })
    spark.sparkContext.setLogLevel("ERROR")

    per_query = {}
    for name in names:
        fn = QUERIES[name]
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                times.append(dt)
        per_query[name] = round(statistics.median(times), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(per_query.values()), 3),
        "unit": "sec",
        "queries": per_query,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
