"""Relational and ML operators over trip frames."""

from .areas import (
    area_profitability,
    area_profitability_join,
    dropoff_keys,
    empty_taxis,
    last_half_hour_dropoffs,
    last_minutes_dropoffs,
    last_quarter_hour_dropoffs,
    mean_revenue,
    profitable_areas,
    profitable_areas_index,
    rank_areas,
)
from .routes import rank_routes, route_counts, route_keys, top_routes, top_routes_index
from .stands import (
    StandSweep,
    assignment,
    busiest_cell_centres,
    counted_points,
    fit_stands,
    laid_out_points,
    sse,
    stand_lines,
    stand_points,
    sweep_stands,
    unpack_points,
)
from .topk import ranked_index, top_n_per_group

__all__ = [
    "area_profitability",
    "area_profitability_join",
    "dropoff_keys",
    "empty_taxis",
    "last_half_hour_dropoffs",
    "last_minutes_dropoffs",
    "last_quarter_hour_dropoffs",
    "mean_revenue",
    "profitable_areas",
    "profitable_areas_index",
    "rank_areas",
    "rank_routes",
    "route_counts",
    "route_keys",
    "top_routes",
    "top_routes_index",
    "StandSweep",
    "assignment",
    "busiest_cell_centres",
    "counted_points",
    "fit_stands",
    "laid_out_points",
    "sse",
    "stand_lines",
    "stand_points",
    "sweep_stands",
    "unpack_points",
    "ranked_index",
    "top_n_per_group",
]
