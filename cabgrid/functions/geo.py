"""Grid cells and routes as Column expressions (no Python per row).

A point maps to cell ``x.y`` on a 500 m grid whose cell 1.1 is centred on
(GRID_X0, GRID_Y0); x grows to the east, y to the south.  The arithmetic
keeps the order ``1 + floor(1/2 + (v - origin) / step)`` so that points on a
cell edge fall the same way as in the original job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .._cols import as_col

# Step between cell centres in degrees (folds to exactly 0.005986 and
# 0.004491556; kept as products so the derivation stays visible).
LON_STEP = C.CELL_METRES * C.LON_DEGREES_PER_METRE
LAT_STEP = C.CELL_METRES * C.LAT_DEGREES_PER_METRE


def cell_x(lon) -> Column:
    """Column index (1 = westmost) of a longitude, as a long."""
    return F.lit(1) + F.floor(F.lit(0.5) + (as_col(lon) - F.lit(C.GRID_X0)) / F.lit(LON_STEP))


def cell_y(lat) -> Column:
    """Row index (1 = northmost) of a latitude, as a long."""
    return F.lit(1) + F.floor(F.lit(0.5) + (F.lit(C.GRID_Y0) - as_col(lat)) / F.lit(LAT_STEP))


def cell_id(lat, lon) -> Column:
    """Cell name ``"x.y"`` of a point, e.g. ``"150.160"``."""
    return cell_name(cell_x(lon), cell_y(lat))


def cell_name(x, y) -> Column:
    """Cell name from the two indices of :func:`cell_x` / :func:`cell_y`."""
    return F.concat_ws(".", as_col(x).cast("string"), as_col(y).cast("string"))


def route_id(pickup_cell, dropoff_cell) -> Column:
    """Route name ``"px.py-dx.dy"`` from two cell names."""
    return F.concat_ws("-", as_col(pickup_cell), as_col(dropoff_cell))


def with_cells(trips, pickup_cell: str = "pickup_cell", dropoff_cell: str = "dropoff_cell"):
    """Add the pickup and drop-off cell names to a trip frame."""
    return trips.withColumns(
        {
            pickup_cell: cell_id("pickup_latitude", "pickup_longitude"),
            dropoff_cell: cell_id("dropoff_latitude", "dropoff_longitude"),
        }
    )
