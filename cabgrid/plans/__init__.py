"""Composite questions, the registered query catalogue and its SQL oracle."""

from .questions import (
    frequent_routes,
    frequent_routes_index,
    profitable_areas,
    profitable_areas_index,
    taxi_stands,
)

__all__ = [
    "frequent_routes",
    "frequent_routes_index",
    "profitable_areas",
    "profitable_areas_index",
    "taxi_stands",
]
