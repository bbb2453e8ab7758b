"""Benchmark the headline queries; prints ONE JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8).  Each query runs to completion through the ``noop`` sink (every
row is produced, nothing is collected to the driver); the first, untimed pass
warms the JVM and Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievekit.plans import QUERIES  # noqa: E402
from sievekit.session import local_session  # noqa: E402

HEADLINE = [
    "average_scores",          # 5-run PVI + EL2N, averaged, misses
    "undersample_grid",        # 2 scores x 2 types x 10 rates in one ranking
    "random_prune",            # 5 seeds x 10 rates, exact sample sizes
    "evaluate_grid",           # macro-F1 over 200 retrained-model cells
    "score_curve",             # mean / std curves with the unpruned baseline
    "mutual_information",      # tree explosion -> incidence -> MI
    "merge_by_majority",       # top-K -> merged groups -> MI
    "build_vocabulary",        # word counts -> ranked vocabulary
    "ngram_mutual_information",  # n-grams of every document -> MI
    "facility_location_select",  # block greedy diversity selection
    "macro_f1_lineitem",       # F1 over a lineitem-sized table
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, driver_memory="16g",
                          app="sievekit-bench")
    names = [n for n in HEADLINE if n in QUERIES]
    _run(QUERIES[names[0]](spark, sf_dir))  # warm-up
    times = {}
    for n in names:
        t0 = time.perf_counter()
        _run(QUERIES[n](spark, sf_dir))
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
