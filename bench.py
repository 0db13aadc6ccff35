"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed to completion with the ``noop`` sink (full computation, no
collect to the driver); the reported time per query is the median of
$BENCH_REPEATS runs after one warm-up run of the flagship.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from raremetrics.plans import catalog  # noqa: E402
from raremetrics.session import build_session  # noqa: E402

HEADLINE = ["nominal_cpue", "shots_enriched", "catch_effort_profile", "effort_grid_class",
            "predictor_positive", "boxplot_stats", "kde_grid", "effort_bins", "level_catch",
            "stratified_split", "bootstrap_draws", "auc_exact", "zip_index", "boot_index"]
# model fits run once (each is already dozens of Spark jobs)
RUN_ONCE = {"zip_index", "boot_index"}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(master=f"local[{cpus}]", app="raremetrics-bench",
                          shuffle_partitions=int(cpus) * 2)
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    catalog.QUERIES["nominal_cpue"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(1 if name in RUN_ONCE else repeats):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
