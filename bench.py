"""Times the named reports on local cores and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of cores, ``BENCH_RUNS`` the timed
runs per query (the best counts), ``BENCH_QUERIES`` an optional comma-separated choice.  Every query
runs once untimed first.  A run covers building the plan and producing every result row.
"""

from __future__ import annotations

import json
import os
import time

from spillway.catalog import QUERIES
from spillway.catalog.reports import REPORTS
from spillway.session import session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
CHOICE = os.environ.get("BENCH_QUERIES")


def run(spark, query) -> float:
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session(
        "bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    names = CHOICE.split(",") if CHOICE else list(REPORTS)
    seconds = {}
    for name in names:
        run(spark, QUERIES[name])
        seconds[name] = round(min(run(spark, QUERIES[name]) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "named reports, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(FOLDER)).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
