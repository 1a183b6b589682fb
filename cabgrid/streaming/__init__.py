"""Incremental (Structured Streaming) forms of the batch questions."""

from .incremental import (
    TotalsTable,
    area_totals_stream,
    profitable_areas_from_totals,
    route_totals_stream,
    stream_trips,
    top_routes_from_totals,
)

__all__ = [
    "TotalsTable",
    "area_totals_stream",
    "profitable_areas_from_totals",
    "route_totals_stream",
    "stream_trips",
    "top_routes_from_totals",
]
