"""Benchmark: run the registered queries at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (the whole plan runs,
nothing is collected to the driver).  Every query first runs once on the
sf0.01 fixture (JVM start-up, JIT and code generation are not charged to
the measurement), then ``BENCH_REPS`` times (default 2) at the target
scale; ``value`` sums each query's best run, ``cold`` keeps the first run.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.queries import QUERIES  # noqa: E402
from ledgerlens.session import get_spark  # noqa: E402

# Headline queries first: the three user-facing reports.
HEADLINE = ("aged_receivable_lines", "aged_payable_lines", "aged_by_partner",
            "undelivered_lines", "undelivered_report", "attachments_main")


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("ledgerlens-bench", master=f"local[{cpus}]",
                      shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reps = max(1, int(os.environ.get("BENCH_REPS", "2")))
    names = list(HEADLINE) + [n for n in QUERIES if n not in HEADLINE]
    warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    if os.path.isdir(warm_dir) and warm_dir != sf_dir:
        for name in names:
            _run(QUERIES[name](spark, warm_dir))

    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            _run(QUERIES[name](spark, sf_dir))  # plan building is timed too
            runs.append(time.perf_counter() - t0)
        cold[name] = round(runs[0], 3)
        times[name] = round(min(runs), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "reps": reps,
        "headline_sec": round(sum(times[n] for n in HEADLINE), 3),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
