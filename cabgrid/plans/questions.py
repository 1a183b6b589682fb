"""The three questions, each from a raw trip frame to its answer.

Each starts with the validity filter, so Catalyst can push it into the scan
and prune to the columns the question reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .. import constants as C
from ..functions.quality import valid_trips
from ..operators import areas, routes, stands


def frequent_routes(trips: DataFrame, n: int = C.TOP_N) -> DataFrame:
    """Q1 flat: (weekday, hour, route, trip_count, rank), rank 1..n."""
    return routes.top_routes(valid_trips(trips), n)


def frequent_routes_index(trips: DataFrame, n: int = C.TOP_N, sep: str | None = None) -> DataFrame:
    """Q1 index: (weekday, hour, routes) with routes in rank order."""
    return routes.top_routes_index(valid_trips(trips), n, sep)


def profitable_areas(trips: DataFrame, n: int = C.TOP_N) -> DataFrame:
    """Q2 flat: (weekday, hour, cell, empty_taxis, mean_revenue, profitability, rank)."""
    return areas.profitable_areas(valid_trips(trips), n)


def profitable_areas_index(trips: DataFrame, n: int = C.TOP_N, sep: str | None = None) -> DataFrame:
    """Q2 index: (weekday, hour, cells) with cells in rank order."""
    return areas.profitable_areas_index(valid_trips(trips), n, sep)


def taxi_stands(
    trips: DataFrame,
    ks: Sequence[int] = C.STAND_KS,
    seed: int = C.KMEANS_SEED,
    **params,
) -> stands.StandSweep:
    """Q3: one k-means model per k over the pickup points of valid trips.

    The returned sweep gives ``centres()``, ``sse()``, ``assignment()`` and ``facts()``;
    call ``release()`` when done with it.
    """
    return stands.sweep_stands(valid_trips(trips), ks, seed, **params)
