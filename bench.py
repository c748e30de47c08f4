"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. All
queries run once to warm up, then a query's time is the median of BENCH_RUNS runs
(5) into the noop sink. Query names given as arguments restrict the run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidewatch.plans.queries import all_queries
from tidewatch.session import local_session


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    queries = all_queries()
    names = sys.argv[1:] or list(queries)
    spark = local_session(cpus=cpus, shuffle_partitions=cpus, memory="16g")
    for name in names:
        timed(queries[name], spark, sf_dir)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(timed(queries[name], spark, sf_dir) for _ in range(runs)), 4)
    result = {
        "metric": "total of median query seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
        "shuffle_partitions": cpus,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
