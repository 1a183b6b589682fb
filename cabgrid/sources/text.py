"""Plain text lines of raw trip records, split on commas (no quoting)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import cell_id
from ..functions.quality import non_empty_line, valid_trip
from ..schema import RAW_TEXT_SCHEMA
from .records import fields_of_array, trips_from_records, typed_records


def read_trip_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path)


def parse_trip_lines(lines: DataFrame, line_col: str = "value", keep=()) -> DataFrame:
    """Non-empty lines → 17 typed raw fields (plus any ``keep`` columns).

    The line is split once per row; a short line or a bad number yields
    NULL fields rather than an error.
    """
    parts = F.split(F.col(line_col), ",")
    return lines.where(non_empty_line(line_col)).select(*keep, *fields_of_array(parts))


TRIP_ROW = (
    "pickup_datetime",
    "dropoff_datetime",
    "trip_time_in_secs",
    "trip_distance",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "fare_amount",
    "tip_amount",
    "total_amount",
)


def trip_rows(lines: DataFrame, line_col: str = "value", keep=()) -> DataFrame:
    """Non-empty lines → the 14-field trip row: the 11 fields of ``TRIP_ROW``,
    ``pickup_cell``, ``dropoff_cell`` and ``taxi_id``.

    A cell is NULL where a coordinate of it is missing or malformed.
    """

    def cell(end: str):
        lat, lon = F.col(f"{end}_latitude"), F.col(f"{end}_longitude")
        return F.when(lat.isNotNull() & lon.isNotNull(), cell_id(lat, lon)).alias(f"{end}_cell")

    raw = parse_trip_lines(lines, line_col, keep)
    return raw.select(*keep, *TRIP_ROW, cell("pickup"), cell("dropoff"), F.col("medallion").alias("taxi_id"))


# The only trip columns any question reads.
NEEDED = (
    "pickup_ts",
    "dropoff_ts",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "fare_amount",
    "tip_amount",
)


def line_outcomes(lines: DataFrame, line_col: str = "value", keep=()) -> DataFrame:
    """Why each line is kept or dropped: empty, malformed, outside or valid.

    ``malformed`` means a field the queries read is missing or unparsable;
    ``outside`` a zero or out-of-area coordinate.
    """
    parts = F.split(F.col(line_col), ",")
    parsed = trips_from_records(lines.select(*keep, F.col(line_col), *fields_of_array(parts)))
    missing = F.lit(False)
    for c in NEEDED:
        missing = missing | F.col(c).isNull()
    outcome = (
        F.when(~non_empty_line(line_col), F.lit("empty"))
        .when(missing, F.lit("malformed"))
        .when(~valid_trip(), F.lit("outside"))
        .otherwise(F.lit("valid"))
    )
    return parsed.select(*keep, outcome.alias("outcome"))


def read_trip_records_text(spark: SparkSession, path: str) -> DataFrame:
    """The 17 raw fields of plain comma-separated text files (no quoting).

    Spark's delimited-text reader with quoting turned off splits on every
    comma, like :func:`parse_trip_lines`, but splits each line once inside
    the scan; splitting a string column instead lets Catalyst inline the
    split into every term of a later filter.  Both type the fields with
    :mod:`cabgrid.sources.records`.  Blank lines are skipped.
    """
    reader = spark.read.schema(RAW_TEXT_SCHEMA).option("sep", ",").option("quote", "").option("header", "false")
    return typed_records(reader.option("mode", "PERMISSIVE").csv(path))


def read_trips_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files as the trip frame (raw fields plus parsed time stamps)."""
    return trips_from_records(read_trip_records_text(spark, path))
