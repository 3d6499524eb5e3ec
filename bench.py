"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is fully
materialised with the ``noop`` sink (no collect to the driver); the timing
includes planning and any writes the query makes.  Before timing, the flagship
query runs once on the same data and the call inventory once on the smallest
scale (to start the Python workers); neither is counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.catalog import QUERIES  # noqa: E402
from quarry.session import local_session  # noqa: E402

HEADLINE = [
    "sensor_aggregated",     # flagship: scan -> transform -> 2 left joins -> aggregate
    "sensor_detailed",       # + skew-safe range rank + constants
    "reading_rank_window",   # the plain window rank, for comparison
    "run_report",            # whole job: 2 table writes + report
    "calls_dedup",           # script inventory: parse, reach, resolve, de-dup
    "io_inventory",          # sources / sinks per script
    "inline_call_sites",     # calls inside page scripts
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=max(int(cpus) * 2, 8) if cpus.isdigit() else 16,
                          app="quarry-bench")
    QUERIES["sensor_aggregated"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):
        QUERIES["calls_dedup"](spark, small).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
