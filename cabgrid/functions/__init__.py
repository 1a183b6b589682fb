"""Column-level building blocks: grid cells, time parts, validity predicates."""

from .geo import cell_id, cell_x, cell_y, route_id, with_cells
from .quality import in_box, non_empty_line, on_grid, valid_trip, valid_trips
from .timeparts import (
    hour_text,
    in_last_minutes,
    minute_of,
    parse_datetime,
    weekday_name,
)

__all__ = [
    "cell_id",
    "cell_x",
    "cell_y",
    "route_id",
    "with_cells",
    "in_box",
    "non_empty_line",
    "on_grid",
    "valid_trip",
    "valid_trips",
    "hour_text",
    "in_last_minutes",
    "minute_of",
    "parse_datetime",
    "weekday_name",
]
