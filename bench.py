"""Benchmark: every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf", ...}. Each query is forced to completion with a ``noop`` write (full
execution, nothing collected). The one-off materialization of the derived
``bank_churn`` table is timed separately as ``bank_churn_build`` and
included in the total.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = set(sys.argv[1:])

    from churnlens.session import local_session
    from churnlens.sources.bank_churn import bank_churn
    from churnlens.plans.catalog import queries

    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    times: dict[str, float] = {}

    t = time.perf_counter()
    n = bank_churn(spark, sf_dir).count()
    times["bank_churn_build"] = round(time.perf_counter() - t, 3)

    for name, fn in queries().items():
        if only and name not in only:
            continue
        t = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "rows": n,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
