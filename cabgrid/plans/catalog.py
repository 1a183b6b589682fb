"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Every query reads the driver's ``events`` table in ``sf_dir`` (whole table,
no sampling or row caps) and derives trips or raw trip lines from it with
:mod:`cabgrid.sources.events`.  Queries on raw lines first write the lines
as a text file in the shared folder and read that back like any text source.
Names match :mod:`cabgrid.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, quality, timeparts
from ..operators import areas, routes, stands
from ..schema import RAW_COLUMNS
from ..session import new_table_path
from ..sinks import preview, write_index, write_stand_lines
from ..sources import (
    parse_trip_lines,
    read_trip_csv,
    read_trip_lines,
    read_trips_text,
    trip_lines_from_events,
    trip_rows,
    trips_from_events,
    trips_from_records,
)
from ..sources.text import line_outcomes
from ..streaming import incremental
from . import questions

TRIP_COLS = (
    "event_id",
    "medallion",
    "pickup_ts",
    "dropoff_ts",
    "trip_time_in_secs",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "fare_amount",
    "tip_amount",
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def _trips(spark, sf_dir):
    return trips_from_events(_events(spark, sf_dir))


def _valid(spark, sf_dir):
    return quality.valid_trips(_trips(spark, sf_dir))


def _lines(spark, sf_dir):
    return trip_lines_from_events(_events(spark, sf_dir))


def line_file(spark: SparkSession, sf_dir: str) -> str:
    """Write the derived raw lines as text in the shared folder, a file per
    partition of the source.

    Queries on raw lines then start from text files, like any text source,
    instead of carrying the line-building expression in their plan.
    """
    path = new_table_path(spark, "lines")
    _lines(spark, sf_dir).select("value").write.text(path)
    return path


def _line_trips(spark, sf_dir):
    return read_trips_text(spark, line_file(spark, sf_dir))


# --- trips, predicates, scalar functions ---------------------------------------


def valid_trips(spark, sf_dir):
    return _valid(spark, sf_dir).select(*TRIP_COLS)


def grid_cells(spark, sf_dir):
    return geo.with_cells(_valid(spark, sf_dir)).select("event_id", "pickup_cell", "dropoff_cell")


def trip_routes(spark, sf_dir):
    return routes.route_keys(_valid(spark, sf_dir), keep=["event_id"])


def trip_time_parts(spark, sf_dir):
    return _trips(spark, sf_dir).select(
        "event_id",
        timeparts.weekday_name("pickup_ts").alias("pickup_weekday"),
        timeparts.hour_text("pickup_ts").alias("pickup_hour"),
        timeparts.weekday_name("dropoff_ts").alias("dropoff_weekday"),
        timeparts.hour_text("dropoff_ts").alias("dropoff_hour"),
        timeparts.minute_of("dropoff_ts").alias("dropoff_minute"),
    )


def last_half_hour_dropoffs(spark, sf_dir):
    return areas.last_half_hour_dropoffs(_valid(spark, sf_dir)).select(*TRIP_COLS)


def last_quarter_hour_dropoffs(spark, sf_dir):
    return areas.last_quarter_hour_dropoffs(_valid(spark, sf_dir)).select(*TRIP_COLS)


def trip_revenue(spark, sf_dir):
    return areas.dropoff_keys(areas.usable(_valid(spark, sf_dir)), keep=["event_id"])


# --- Q1: frequent routes --------------------------------------------------------


def route_counts(spark, sf_dir):
    return routes.route_counts(_valid(spark, sf_dir))


def top_routes(spark, sf_dir):
    return questions.frequent_routes(_trips(spark, sf_dir))


def top_routes_index(spark, sf_dir):
    return questions.frequent_routes_index(_trips(spark, sf_dir), sep=",")


def route_preview(spark, sf_dir):
    return preview(top_routes_index(spark, sf_dir), ["weekday", "hour"], 2)


# --- Q2: profitable areas -------------------------------------------------------


def empty_taxis(spark, sf_dir):
    return areas.empty_taxis(_valid(spark, sf_dir))


def mean_revenue(spark, sf_dir):
    return areas.mean_revenue(_valid(spark, sf_dir))


def area_profitability_join(spark, sf_dir):
    return areas.area_profitability_join(_valid(spark, sf_dir))


def area_profitability(spark, sf_dir):
    return areas.area_profitability(_valid(spark, sf_dir))


def profitable_areas(spark, sf_dir):
    return questions.profitable_areas(_trips(spark, sf_dir))


def profitable_areas_index(spark, sf_dir):
    return questions.profitable_areas_index(_trips(spark, sf_dir), sep=",")


def area_preview(spark, sf_dir):
    return preview(profitable_areas_index(spark, sf_dir), ["weekday", "hour"], 10)


# --- Q3: taxi stands ------------------------------------------------------------


def stand_points(spark, sf_dir):
    pts = stands.stand_points(_valid(spark, sf_dir), keep=["event_id"])
    return stands.unpack_points(pts, keep=["event_id"])


def _sweep(spark, sf_dir) -> stands.StandSweep:
    return questions.taxi_stands(_trips(spark, sf_dir), C.STAND_KS, C.KMEANS_SEED)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write a result into the shared folder and read it back."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Each stands query releases its persisted points before returning: centres
# are plain values of the fitted models, and the point-based results are
# written as small tables first.


def taxi_stands(spark, sf_dir):
    sweep = _sweep(spark, sf_dir)
    try:
        return sweep.centres()
    finally:
        sweep.release()


def stand_lines(spark, sf_dir):
    return stands.stand_lines(taxi_stands(spark, sf_dir))


def stand_sse(spark, sf_dir):
    sweep = _sweep(spark, sf_dir)
    try:
        return _written(sweep.sse(), "stand-sse")
    finally:
        sweep.release()


def stand_assignment(spark, sf_dir):
    sweep = _sweep(spark, sf_dir)
    try:
        return _written(sweep.assignment(), "stand-assignment")
    finally:
        sweep.release()


def _stand_files(spark, lines):
    """Stand files written one folder per k, read back as (k, line)."""
    path = new_table_path(spark, "stands")
    write_stand_lines(lines, path)
    return spark.read.text(path).select("k", F.col("value").alias("line"))


def stand_files_roundtrip(spark, sf_dir):
    return _stand_files(spark, stand_lines(spark, sf_dir))


def stand_sweep_facts(spark, sf_dir):
    sweep = _sweep(spark, sf_dir)
    try:
        return _written(sweep.facts(), "stand-facts")
    finally:
        sweep.release()


# The same assignment, cost, text and files for stands that follow from the
# data without a fit, so that SQL can state them.


def fixed_stand_centres(spark, sf_dir):
    return stands.busiest_cell_centres(_valid(spark, sf_dir))


def _pickups(spark, sf_dir):
    names = {"pickup_latitude": "latitude", "pickup_longitude": "longitude"}
    return stands.counted_points(_valid(spark, sf_dir)).withColumnsRenamed(names)


def fixed_stand_assignment(spark, sf_dir):
    return stands.assignment(_pickups(spark, sf_dir), fixed_stand_centres(spark, sf_dir))


def fixed_stand_sse(spark, sf_dir):
    return stands.sse(_pickups(spark, sf_dir), fixed_stand_centres(spark, sf_dir))


def fixed_stand_lines(spark, sf_dir):
    return stands.stand_lines(fixed_stand_centres(spark, sf_dir))


def fixed_stand_files(spark, sf_dir):
    return _stand_files(spark, fixed_stand_lines(spark, sf_dir))


# --- raw text lines -------------------------------------------------------------


def parse_trip_lines_q(spark, sf_dir):
    lines = read_trip_lines(spark, line_file(spark, sf_dir))
    return trips_from_records(parse_trip_lines(lines))


def trip_rows_from_lines(spark, sf_dir):
    return trip_rows(read_trip_lines(spark, line_file(spark, sf_dir)))


def filter_trip_lines(spark, sf_dir):
    return quality.valid_trips(_line_trips(spark, sf_dir))


def trip_line_outcomes(spark, sf_dir):
    out = line_outcomes(read_trip_lines(spark, line_file(spark, sf_dir)))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


def top_routes_from_lines(spark, sf_dir):
    return questions.frequent_routes(_line_trips(spark, sf_dir))


def profitable_areas_from_lines(spark, sf_dir):
    return questions.profitable_areas(_line_trips(spark, sf_dir))


# --- the same questions maintained by Structured Streaming ----------------------


def top_routes_streaming(spark, sf_dir):
    src = line_file(spark, sf_dir)
    totals, _ = incremental.route_totals_stream(incremental.stream_trips(spark, src, "text", max_files=1))
    return incremental.top_routes_from_totals(totals)


def profitable_areas_streaming(spark, sf_dir):
    src = line_file(spark, sf_dir)
    totals, _ = incremental.area_totals_stream(incremental.stream_trips(spark, src, "text", max_files=1))
    return incremental.profitable_areas_from_totals(totals)


# --- sources and sinks through the shared folder --------------------------------


def text_roundtrip(spark, sf_dir):
    path = line_file(spark, sf_dir)
    return parse_trip_lines(read_trip_lines(spark, path)).select(*RAW_COLUMNS)


def csv_roundtrip(spark, sf_dir):
    path = line_file(spark, sf_dir)
    return read_trip_csv(spark, path).select(*RAW_COLUMNS)


def route_index_roundtrip(spark, sf_dir):
    path = new_table_path(spark, "route-index")
    write_index(questions.frequent_routes_index(_trips(spark, sf_dir)), path, fmt="parquet")
    back = spark.read.parquet(path)
    return back.select("weekday", "hour", F.array_join("routes", ",").alias("routes"))


def area_index_roundtrip(spark, sf_dir):
    path = new_table_path(spark, "area-index")
    write_index(questions.profitable_areas_index(_trips(spark, sf_dir)), path, fmt="text")
    parts = F.split(F.col("value"), "\t")
    back = spark.read.text(path)
    return back.select(parts[0].alias("weekday"), parts[1].alias("hour"), parts[2].alias("cells"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "valid_trips": valid_trips,
    "grid_cells": grid_cells,
    "trip_routes": trip_routes,
    "trip_time_parts": trip_time_parts,
    "last_half_hour_dropoffs": last_half_hour_dropoffs,
    "last_quarter_hour_dropoffs": last_quarter_hour_dropoffs,
    "trip_revenue": trip_revenue,
    "route_counts": route_counts,
    "top_routes": top_routes,
    "top_routes_index": top_routes_index,
    "route_preview": route_preview,
    "empty_taxis": empty_taxis,
    "mean_revenue": mean_revenue,
    "area_profitability_join": area_profitability_join,
    "area_profitability": area_profitability,
    "profitable_areas": profitable_areas,
    "profitable_areas_index": profitable_areas_index,
    "area_preview": area_preview,
    "stand_points": stand_points,
    "taxi_stands": taxi_stands,
    "stand_lines": stand_lines,
    "stand_sse": stand_sse,
    "stand_assignment": stand_assignment,
    "stand_files_roundtrip": stand_files_roundtrip,
    "stand_sweep_facts": stand_sweep_facts,
    "fixed_stand_centres": fixed_stand_centres,
    "fixed_stand_assignment": fixed_stand_assignment,
    "fixed_stand_sse": fixed_stand_sse,
    "fixed_stand_lines": fixed_stand_lines,
    "fixed_stand_files": fixed_stand_files,
    "parse_trip_lines": parse_trip_lines_q,
    "trip_rows_from_lines": trip_rows_from_lines,
    "filter_trip_lines": filter_trip_lines,
    "trip_line_outcomes": trip_line_outcomes,
    "top_routes_from_lines": top_routes_from_lines,
    "profitable_areas_from_lines": profitable_areas_from_lines,
    "top_routes_streaming": top_routes_streaming,
    "profitable_areas_streaming": profitable_areas_streaming,
    "text_roundtrip": text_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "route_index_roundtrip": route_index_roundtrip,
    "area_index_roundtrip": area_index_roundtrip,
}

# The centres of an iterative fit; no SQL states them (what follows from given
# centres is checked by the fixed_stand queries).
NO_ORACLE = ("taxi_stands", "stand_lines", "stand_sse", "stand_assignment", "stand_files_roundtrip")
