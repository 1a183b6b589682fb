"""Row predicates that decide which trips take part in the queries.

All are plain Column expressions on raw columns, so Catalyst can push them
into the Parquet or CSV scan (``PushedFilters``) when the coordinates are
stored columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .._cols import as_col
from .geo import cell_x, cell_y

COORDINATES = ("pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude")


def non_empty_line(line="value") -> Column:
    return F.length(as_col(line)) > 0


def in_box(lat, lon) -> Column:
    """Point lies inside the study area (bounds included)."""
    return as_col(lon).between(C.LON_MIN, C.LON_MAX) & as_col(lat).between(C.LAT_MIN, C.LAT_MAX)


def valid_trip() -> Column:
    """Both ends known, non-zero and inside the study area.

    A NULL coordinate (unparsable input) makes the predicate NULL, which a
    filter treats as false, so malformed trips drop out here too.
    """
    non_zero = reduce(lambda a, b: a & b, [as_col(c) != F.lit(0.0) for c in COORDINATES])
    return (
        non_zero
        & in_box("pickup_latitude", "pickup_longitude")
        & in_box("dropoff_latitude", "dropoff_longitude")
    )


def on_grid() -> Column:
    """Both ends fall in grid cells 1..300 on both axes.

    The box bounds are inclusive, so a point on the exact north-west corner
    (or a latitude a hair under the north edge) maps to index 0 although it
    is inside the box.  This stricter test drops such points.
    """
    idx = [
        cell_x("pickup_longitude"),
        cell_y("pickup_latitude"),
        cell_x("dropoff_longitude"),
        cell_y("dropoff_latitude"),
    ]
    return reduce(lambda a, b: a & b, [i.between(1, C.GRID_CELLS) for i in idx])


def valid_trips(trips, strict_cells: bool = False):
    """Keep only trips that satisfy :func:`valid_trip`.

    ``strict_cells=True`` also requires :func:`on_grid` (off by default, as
    in the original job).
    """
    cond = valid_trip()
    if strict_cells:
        cond = cond & on_grid()
    return trips.where(cond)
