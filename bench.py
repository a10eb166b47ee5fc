"""Benchmark the headline queries.

Runs each query's full plan (``noop`` sink: every row is computed, nothing is
collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one
JSON line with the median wall time per query.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEATS (default 5, after one warm-up), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "D1_purchase_features", "D2_likes_features", "D3_comments_features", "D4_buyer_table",
    "E1_target_encoding", "V8_threshold_optimization", "C1_composite_score", "L6_qini_curve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from buyerlens.plans.catalog import all_queries
    from buyerlens.session import get_session

    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
             "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)}
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                        app_name="buyerlens-bench", extra=extra)
    qs = all_queries()
    timings = {}
    for name in names:
        q = qs[name]
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        timings[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_median", "value": round(sum(timings.values()), 3),
           "unit": "sec", "queries": timings, "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus, "repeats": repeats}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
