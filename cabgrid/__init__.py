"""cabgrid: taxi-trip analytics on Spark DataFrames.

Three questions over trip records, all expressed with built-in Spark SQL
expressions and Spark ML:

* the most frequent routes between 500 m grid cells per weekday and hour;
* the most profitable drop-off cells per weekday and hour;
* where to place k taxi stands (k-means over pickup points).
"""

from .plans.answers import write_answers
from .plans.questions import (
    frequent_routes,
    frequent_routes_index,
    profitable_areas,
    profitable_areas_index,
    taxi_stands,
)
from .sources import read_trips_csv, read_trips_text

__all__ = [
    "frequent_routes",
    "frequent_routes_index",
    "profitable_areas",
    "profitable_areas_index",
    "taxi_stands",
    "read_trips_csv",
    "read_trips_text",
    "write_answers",
]
