"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2; the best run per query is reported, i.e. a warm run).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablescope.plans import catalog  # noqa: E402
from tablescope.session import get_session  # noqa: E402

HEADLINE = [
    "column_summary", "numeric_profile", "categorical_profile", "datetime_profile_events", "missing_profile",
    "missing_combinations", "duplicate_rows", "outliers_iqr", "outliers_modified_z", "outliers_by_group",
    "corr_pairs", "chi_square", "group_effect", "group_effect_kruskal", "mutual_information", "health_score",
    "histogram", "box_stats", "format_checks", "kmeans",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            df = catalog.QUERIES[name](spark, sf_dir)
            n = 0
            for _r in df.toLocalIterator():
                n += 1
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        rows[name] = n
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_warm_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "shuffle_partitions": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
