"""Trip sources: typed CSV, plain text lines, and the ``events`` adapter."""

from .csv import read_trip_csv, read_trips_csv
from .events import trip_lines_from_events, trips_from_events
from .records import trips_from_records, typed_fields, typed_records
from .text import parse_trip_lines, read_trip_lines, read_trip_records_text, read_trips_text, trip_rows

__all__ = [
    "read_trip_csv",
    "read_trips_csv",
    "trip_lines_from_events",
    "trips_from_events",
    "trips_from_records",
    "trip_rows",
    "typed_fields",
    "typed_records",
    "parse_trip_lines",
    "read_trip_lines",
    "read_trip_records_text",
    "read_trips_text",
]
