"""Print the physical plans of the headline queries as Markdown.

Usage: python tests/show_plans.py [sf_dir] > PLANS.md

Plans are shown with AQE off, i.e. the static plan Catalyst picks before
run-time re-planning (AQE can only coalesce partitions or switch a join to
broadcast after measuring; it does not add exchanges).  Lines longer than
220 characters (the test-data derivation expressions) are cut.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cabgrid.functions import valid_trips  # noqa: E402
from cabgrid.plans import catalog, questions  # noqa: E402
from cabgrid.session import local_session  # noqa: E402
from cabgrid.sources import read_trips_text  # noqa: E402


def _plan(df, mode: str) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue().strip()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    trips = catalog._trips(spark, sf_dir)
    lines = catalog.line_file(spark, sf_dir)
    text_trips = read_trips_text(spark, lines)
    sweep = questions.taxi_stands(trips)
    shown = [
        ("Q1 top routes", questions.frequent_routes(trips), "simple"),
        ("Q1 index", questions.frequent_routes_index(trips, sep=","), "simple"),
        ("Q2 profitable areas (single pass)", questions.profitable_areas(trips), "simple"),
        ("Q2 join form (J1), broadcast off as at scale", "J1", "simple"),
        (
            "Q1's columns from a text file: filters and pruning in the scan",
            valid_trips(text_trips).select(
                "pickup_ts", "pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude"
            ),
            "formatted",
        ),
        ("Q3 SSE for all k in one pass", sweep.sse(), "simple"),
    ]
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `tests/show_plans.py` on `{os.path.basename(sf_dir)}`, AQE off (static plans).\n")
    for title, df, mode in shown:
        if df == "J1":
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            text = _plan(catalog.area_profitability_join(spark, sf_dir), mode)
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        else:
            text = _plan(df, mode)
        text = text.replace(lines, "<lines>").replace(tempfile.gettempdir(), "<tmp>")
        text = "\n".join(ln if len(ln) <= 220 else ln[:220] + " …" for ln in text.splitlines())
        print(f"## {title}\n\n```\n{text}\n```\n")
    sweep.release()


if __name__ == "__main__":
    main()
