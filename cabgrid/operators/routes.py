"""Routes between grid cells and the most frequent routes per weekday/hour.

Inputs are trip frames that already passed :func:`cabgrid.functions.valid_trips`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .._cols import typed_once
from ..functions.geo import cell_name, cell_x, cell_y, route_id, with_cells
from ..functions.quality import COORDINATES
from ..functions.timeparts import day_number, hour_number_text, hour_text, weekday_from_number, weekday_name
from .topk import ranked_index, top_n_per_group

KEYS = ("weekday", "hour")


def route_keys(trips: DataFrame, keep=()) -> DataFrame:
    """Pickup weekday, pickup hour and route of every trip with a pickup time."""
    t = with_cells(trips.where(F.col("pickup_ts").isNotNull()))
    return t.select(
        *keep,
        weekday_name("pickup_ts").alias("weekday"),
        hour_text("pickup_ts").alias("hour"),
        route_id("pickup_cell", "dropoff_cell").alias("route"),
    )


_INDEX = ("_day", "_hour", "_px", "_py", "_dx", "_dy")


def _index_counts(trips: DataFrame) -> DataFrame:
    """Trips per (day, hour, four cell indices), all small integers.

    A plain count: Spark combines map-side, so a hot route costs one row per
    map task in the shuffle, whatever its size.
    """
    t = typed_once(trips, ["pickup_ts"], COORDINATES).where(F.col("pickup_ts").isNotNull())
    keyed = t.select(
        day_number("pickup_ts").alias("_day"),
        F.hour("pickup_ts").alias("_hour"),
        cell_x("pickup_longitude").alias("_px"),
        cell_y("pickup_latitude").alias("_py"),
        cell_x("dropoff_longitude").alias("_dx"),
        cell_y("dropoff_latitude").alias("_dy"),
    )
    return keyed.groupBy(*_INDEX).agg(F.count(F.lit(1)).alias("trip_count"))


def _route() -> Column:
    return route_id(cell_name("_px", "_py"), cell_name("_dx", "_dy")).alias("route")


def _named_keys() -> list[Column]:
    return [weekday_from_number("_day").alias("weekday"), hour_number_text("_hour").alias("hour")]


def route_counts(trips: DataFrame) -> DataFrame:
    """Exact number of trips per (weekday, hour, route).

    Grouped on integers; names are built only for the aggregated rows, so no
    per-trip string work or string shuffle keys.
    """
    return _index_counts(trips).select(*_named_keys(), _route(), "trip_count")


def rank_routes(counts: DataFrame, n: int = C.TOP_N) -> DataFrame:
    """Top n routes per (weekday, hour): most trips first, then route name."""
    return top_n_per_group(counts, KEYS, [F.desc("trip_count"), F.asc("route")], n)


def _best(trips: DataFrame, n: int) -> DataFrame:
    """(_day, _hour, route, trip_count, rank): ranked within integer keys; of
    the names only the route's is needed before the cut, as it breaks ties."""
    counts = _index_counts(trips).select("_day", "_hour", _route(), "trip_count")
    return top_n_per_group(counts, ("_day", "_hour"), [F.desc("trip_count"), F.asc("route")], n)


def top_routes(trips: DataFrame, n: int = C.TOP_N) -> DataFrame:
    """(weekday, hour, route, trip_count, rank) for the n most frequent routes."""
    return _best(trips, n).select(*_named_keys(), "route", "trip_count", "rank")


def top_routes_index(trips: DataFrame, n: int = C.TOP_N, sep: str | None = None) -> DataFrame:
    """(weekday, hour, routes): route names in rank order, gathered on the
    ranking's own partitioning."""
    index = ranked_index(_best(trips, n), ("_day", "_hour"), "route", "routes", sep=sep)
    return index.select(*_named_keys(), "routes")
