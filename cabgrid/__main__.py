"""Command line: answer the questions for a trip file or folder.

    python -m cabgrid trips.csv results/            # all three questions
    python -m cabgrid --format text --questions 1,2 data/ results/

The session is taken with ``getOrCreate``, so the master and resources come
from the environment (``spark-defaults.conf``, ``PYSPARK_SUBMIT_ARGS``);
nothing here fixes them.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import constants as C
from .plans.answers import write_answers
from .sinks import preview
from .sources import read_trips_csv, read_trips_text


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="cabgrid", description=__doc__.split("\n")[0])
    p.add_argument("source", help="file or folder of raw trip records (17 fields, no header)")
    p.add_argument("out", help="output folder")
    p.add_argument("--format", choices=("csv", "text"), default="csv", help="how to read the source")
    p.add_argument("--questions", default="1,2,3", help="comma-separated subset of 1,2,3")
    p.add_argument("--ks", default=",".join(map(str, C.STAND_KS)), help="k values for question 3")
    p.add_argument(
        "--index-format",
        default="pairs",
        choices=("pairs", "text", "parquet", "json"),
        help="pairs: one (('weekday', 'hour'), ['name', ...]) line per key, as the original result files",
    )
    p.add_argument(
        "--preview",
        action="store_true",
        help="also print the first 2 Q1 and first 10 Q2 index rows, as the original job did",
    )
    p.add_argument(
        "--mode", default="overwrite", choices=("overwrite", "error"), help="error: never replace earlier answers"
    )
    p.add_argument(
        "--stand-partitions",
        type=int,
        help="partitions of question 3's points (by default from their number); the stands depend on it",
    )
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName("cabgrid").getOrCreate()
    read = read_trips_csv if a.format == "csv" else read_trips_text
    trips = read(spark, a.source)
    which = [int(q) for q in a.questions.split(",") if q]
    ks = [int(k) for k in a.ks.split(",") if k]
    result = write_answers(trips, a.out, which, ks, a.index_format, mode=a.mode, stand_partitions=a.stand_partitions)
    if a.preview:
        _print_previews(spark, a.out, which, a.index_format)
    for k, sse in result.get("sse", {}).items():
        print(json.dumps({"k": k, "sse": sse}))


def _print_previews(spark, out: str, which, index_format: str) -> None:
    """First rows of the written indexes, in (weekday, hour) order (bounded: 2 and 10)."""
    for q, n in ((1, 2), (2, 10)):
        if q not in which:
            continue
        path = f"{out.rstrip('/')}/query{q}"
        if index_format in ("text", "pairs"):
            lines = spark.read.text(path).orderBy("value").limit(n).collect()
            for r in lines:
                print(r.value)
        else:
            for r in preview(spark.read.format(index_format).load(path), ["weekday", "hour"], n).collect():
                print(tuple(r))


if __name__ == "__main__":
    main()
