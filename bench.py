"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: one cold run, then the median of ``$BENCH_REPEAT``
warm runs (default 3).  Every run executes the full plan into Spark's
``noop`` sink, so nothing is collected to the driver.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.plans.registry import QUERIES  # noqa: E402
from tokenloom.session import get_spark  # noqa: E402

HEADLINE = [
    "flagship",          # M1 -> M3 -> M4 -> M11 -> A10
    "rvq_fit",           # M4
    "rvq_fit_restarts",  # M4, 4 restarts in one pass per iteration
    "rvq_apply",         # M5 + M11
    "dict_fit",          # M6 + M8 + M9
    "omp2_tokens",       # M8-M10
    "knn_exact",         # K1
    "neighbor_purity",   # K3
    "index_recall",      # K4
    "anova",             # A14
    "discrimination_f",  # A14 over all categories
    "upsample",          # R3
    "prompts3",          # R1 + R3
    "split",             # R4
    "tag_outer_merge",   # J1
    "json_stat_objects", # P6-P10 + catalog
    "feature_table",     # S4-S5, J5, P12-P17
    "comprehensive_features",  # P13, 221 features
]


def run_once(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    memory = os.environ.get("BENCH_MEMORY", "16g")
    extra = {"spark.driver.memory": memory}
    event_dir = os.environ.get("BENCH_EVENT_LOG")  # e.g. a fresh mktemp -d folder: stage/task times
    if event_dir:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir})
    spark = get_spark(f"local[{cpus}]", app="tokenloom-bench", shuffle_partitions=int(cpus), extra=extra)
    times, cold = {}, {}
    for name in names:
        cold[name] = round(run_once(spark, name, sf_dir), 3)
        runs = [run_once(spark, name, sf_dir) for _ in range(repeat)]
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "median_warm_sec_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "cold": cold, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus), "driver_memory": memory, "repeat": repeat}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
