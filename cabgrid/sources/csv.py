"""Typed CSV scan of raw trip records (17 fields, no header)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import RAW_TEXT_SCHEMA
from .records import trips_from_records, typed_records


def read_trip_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read raw records with the fixed schema; never infer.

    Fields are read as text and typed by :mod:`cabgrid.sources.records`: an
    unparsable field is NULL and the row stays, so the validity filter (not
    the reader) decides what is dropped.  Empty and blank lines are skipped
    by the reader.  Uncompressed or splittable files are split by
    ``spark.sql.files.maxPartitionBytes``.
    """
    reader = spark.read.schema(RAW_TEXT_SCHEMA).option("header", "false").option("mode", "PERMISSIVE")
    return typed_records(reader.options(**options).csv(path))


def read_trips_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV records as the trip frame (raw fields plus parsed time stamps)."""
    return trips_from_records(read_trip_csv(spark, path, **options))
