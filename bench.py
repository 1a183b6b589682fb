"""Time the headline queries; print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the best run of each query is reported).  Every
query first runs once untimed, so the timings are steady-state (JIT and
generated code warm), as on long-lived executors.
Each query is forced in full with Spark's ``noop`` sink, so nothing is
collected to the driver and every row is computed.  With BENCH_EVENT_LOG set
to a folder, Spark's event log is written there (stage and task times for
``tests/stage_report.py``).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cabgrid.plans import catalog, questions  # noqa: E402
from cabgrid.plans.answers import stage_trips  # noqa: E402
from cabgrid.session import delete_tables, local_session, new_table_path  # noqa: E402
from cabgrid.sources import read_trips_text  # noqa: E402


def _force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _stands(trips):
    sweep = questions.taxi_stands(trips)
    try:
        _force(sweep.centres())
        _force(sweep.sse())
    finally:
        sweep.release()


# Trips are staged as Parquet, and raw lines as text, once before timing: the
# queries then start from stored records, as they would on real input.  The
# ``derived`` rows include the derivation of trips from the events table.
HEADLINE = {
    "q1_top_routes": lambda s, d, t, lines: _force(questions.frequent_routes(t)),
    "q1_top_routes_index": lambda s, d, t, lines: _force(questions.frequent_routes_index(t, sep=",")),
    "q2_profitable_areas": lambda s, d, t, lines: _force(questions.profitable_areas(t)),
    "q2_profitable_areas_index": lambda s, d, t, lines: _force(questions.profitable_areas_index(t, sep=",")),
    "q1_text_lines": lambda s, d, t, lines: _force(questions.frequent_routes(read_trips_text(s, lines))),
    "q2_text_lines": lambda s, d, t, lines: _force(questions.profitable_areas(read_trips_text(s, lines))),
    "q3_taxi_stands": lambda s, d, t, lines: _stands(t),
    "q1_derived": lambda s, d, t, lines: _force(catalog.top_routes(s, d)),
    "q2_derived": lambda s, d, t, lines: _force(catalog.profitable_areas(s, d)),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]}
    spark = local_session(cpus, shuffle_partitions=cpus, app="cabgrid-bench", extra=extra)
    try:
        spark.read.parquet(f"{sf_dir}/events.parquet").count()  # JVM and file-system warm-up
        lines = catalog.line_file(spark, sf_dir)
        trips = stage_trips(catalog._trips(spark, sf_dir), new_table_path(spark, "bench-trips"))

        for run in HEADLINE.values():  # warm-up pass
            run(spark, sf_dir, trips, lines)

        times = {}
        for name, run in HEADLINE.items():
            best = None
            for _ in range(repeat):
                t0 = time.perf_counter()
                run(spark, sf_dir, trips, lines)
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)

        m = re.search(r"sf([0-9.]+)$", sf_dir)
        out = {
            "metric": "total_query_sec",
            "value": round(sum(times.values()), 3),
            "unit": "sec",
            "queries": times,
            "sf": float(m.group(1)) if m else sf_dir,
            "cpus": cpus,
            "repeat": repeat,
        }
        print(json.dumps(out), flush=True)

    finally:
        delete_tables(spark)
        spark.stop()


if __name__ == "__main__":
    main()
