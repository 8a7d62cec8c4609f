"""Times every registered query once on a warm session; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES``
(comma separated) a part of the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from runloom.plans import QUERIES
from runloom.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("run_outcome", "train_gate_register", "row_function"):  # starts compilers and Python workers
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    out = {
        "metric": "all registered queries, wall clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
