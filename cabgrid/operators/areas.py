"""Empty taxis, revenue and profitability of drop-off areas per weekday/hour.

Definitions, per (drop-off weekday, drop-off hour, drop-off cell):

* empty taxis: trips that end in the last 30 minutes of the hour;
* mean revenue: mean of fare + tip over trips that end in the last 15 minutes;
* profitability: mean revenue / empty taxis, only where both exist.

Sums are exact decimals and become doubles only for the division, so the
result does not depend on the order in which partitions are combined.
Inputs are trip frames that already passed :func:`cabgrid.functions.valid_trips`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .._cols import typed_once
from ..functions.geo import cell_id, cell_name, cell_x, cell_y
from ..functions.timeparts import (
    day_number,
    hour_number_text,
    hour_text,
    in_last_minutes,
    minute_of,
    weekday_from_number,
    weekday_name,
)
from .topk import ranked_index, top_n_per_group

KEYS = ("weekday", "hour", "cell")


def usable(trips: DataFrame) -> DataFrame:
    """Trips with the drop-off time, fare and tip the area queries need."""
    return trips.where(
        F.col("dropoff_ts").isNotNull()
        & F.col("fare_amount").isNotNull()
        & F.col("tip_amount").isNotNull()
    )


def last_minutes_dropoffs(trips: DataFrame, from_minute: int) -> DataFrame:
    """Trips whose drop-off lies at or after ``from_minute`` of its hour."""
    return trips.where(in_last_minutes("dropoff_ts", from_minute))


def last_half_hour_dropoffs(trips: DataFrame) -> DataFrame:
    return last_minutes_dropoffs(trips, C.EMPTY_FROM_MINUTE)


def last_quarter_hour_dropoffs(trips: DataFrame) -> DataFrame:
    return last_minutes_dropoffs(trips, C.PROFIT_FROM_MINUTE)


def revenue() -> Column:
    """Fare plus tip, exact decimal."""
    return F.col("fare_amount") + F.col("tip_amount")


def dropoff_keys(trips: DataFrame, keep=()) -> DataFrame:
    """Drop-off weekday, hour, cell and minute, plus the trip's revenue."""
    return trips.select(
        *keep,
        weekday_name("dropoff_ts").alias("weekday"),
        hour_text("dropoff_ts").alias("hour"),
        cell_id("dropoff_latitude", "dropoff_longitude").alias("cell"),
        minute_of("dropoff_ts").alias("minute"),
        revenue().alias("revenue"),
    )


# Aggregations group on small integers (day, hour, cell indices) and name the
# groups afterwards, so per-trip work and shuffle keys stay narrow.
_INDEX = ("_day", "_hour", "_cx", "_cy")


def _dropoff_index(trips: DataFrame, from_minute: int) -> DataFrame:
    read = typed_once(
        trips, ["dropoff_ts", "fare_amount", "tip_amount"], ["dropoff_longitude", "dropoff_latitude"]
    )
    return last_minutes_dropoffs(usable(read), from_minute).select(
        day_number("dropoff_ts").alias("_day"),
        F.hour("dropoff_ts").alias("_hour"),
        cell_x("dropoff_longitude").alias("_cx"),
        cell_y("dropoff_latitude").alias("_cy"),
        minute_of("dropoff_ts").alias("minute"),
        revenue().alias("revenue"),
    )


def _named(agg: DataFrame, *measures: str) -> DataFrame:
    return agg.select(
        weekday_from_number("_day").alias("weekday"),
        hour_number_text("_hour").alias("hour"),
        cell_name("_cx", "_cy").alias("cell"),
        *measures,
    )


def _mean(total: Column, n: Column) -> Column:
    return total.cast("double") / n


def _empty_counts(trips: DataFrame, from_minute: int) -> DataFrame:
    return _dropoff_index(trips, from_minute).groupBy(*_INDEX).agg(F.count(F.lit(1)).alias("empty_taxis"))


def _revenue_means(trips: DataFrame, from_minute: int) -> DataFrame:
    return _dropoff_index(trips, from_minute).groupBy(*_INDEX).agg(
        _mean(F.sum("revenue"), F.count(F.lit(1))).alias("mean_revenue")
    )


def empty_taxis(trips: DataFrame, from_minute: int = C.EMPTY_FROM_MINUTE) -> DataFrame:
    """(weekday, hour, cell, empty_taxis)."""
    return _named(_empty_counts(trips, from_minute), "empty_taxis")


def mean_revenue(trips: DataFrame, from_minute: int = C.PROFIT_FROM_MINUTE) -> DataFrame:
    """(weekday, hour, cell, mean_revenue)."""
    return _named(_revenue_means(trips, from_minute), "mean_revenue")


def area_profitability_join(
    trips: DataFrame,
    empty_from: int = C.EMPTY_FROM_MINUTE,
    profit_from: int = C.PROFIT_FROM_MINUTE,
) -> DataFrame:
    """Profitability as an inner join of the two aggregates.

    The join is on the integer group keys and names are built afterwards, so
    both sides arrive hash-partitioned on the join keys by their own
    aggregation and the join adds no exchange; at run time AQE may still
    turn it into a broadcast join if one side proves small.
    """
    joined = _empty_counts(trips, empty_from).join(_revenue_means(trips, profit_from), list(_INDEX), "inner")
    return _named(joined, "empty_taxis", "mean_revenue").select(
        *KEYS,
        "empty_taxis",
        "mean_revenue",
        (F.col("mean_revenue") / F.col("empty_taxis")).alias("profitability"),
    )


def area_totals(
    trips: DataFrame,
    empty_from: int = C.EMPTY_FROM_MINUTE,
    profit_from: int = C.PROFIT_FROM_MINUTE,
) -> DataFrame:
    """(weekday, hour, cell, empty_taxis, revenue_sum, revenue_trips).

    The later window lies inside the earlier one, so both measures are
    conditional aggregates of one grouping.  All three totals are additive,
    so they can also be kept as streaming state.  Requires
    ``profit_from >= empty_from``.
    """
    if profit_from < empty_from:
        raise ValueError("profit window must lie inside the empty-taxi window")
    late = F.col("minute") >= F.lit(profit_from)
    agg = _dropoff_index(trips, empty_from).groupBy(*_INDEX).agg(
        F.count(F.lit(1)).alias("empty_taxis"),
        F.sum(F.when(late, F.col("revenue"))).alias("revenue_sum"),
        F.count(F.when(late, F.lit(1))).alias("revenue_trips"),
    )
    return _named(agg, "empty_taxis", "revenue_sum", "revenue_trips")


def profitability_from_totals(totals: DataFrame) -> DataFrame:
    """Totals → (weekday, hour, cell, empty_taxis, mean_revenue, profitability).

    Keeping only groups with a late trip gives the inner-join semantics.
    """
    mean = _mean(F.col("revenue_sum"), F.col("revenue_trips"))
    return totals.where(F.col("revenue_trips") > 0).select(
        *KEYS,
        "empty_taxis",
        mean.alias("mean_revenue"),
        (mean / F.col("empty_taxis")).alias("profitability"),
    )


def area_profitability(
    trips: DataFrame,
    empty_from: int = C.EMPTY_FROM_MINUTE,
    profit_from: int = C.PROFIT_FROM_MINUTE,
) -> DataFrame:
    """Same result as :func:`area_profitability_join` in one scan and one shuffle."""
    return profitability_from_totals(area_totals(trips, empty_from, profit_from))


def rank_areas(profit: DataFrame, n: int = C.TOP_N) -> DataFrame:
    """Top n cells per (weekday, hour): most profitable first, then cell name."""
    return top_n_per_group(profit, ("weekday", "hour"), [F.desc("profitability"), F.asc("cell")], n)


def profitable_areas(trips: DataFrame, n: int = C.TOP_N) -> DataFrame:
    """(weekday, hour, cell, empty_taxis, mean_revenue, profitability, rank)."""
    return rank_areas(area_profitability(trips), n)


def profitable_areas_index(trips: DataFrame, n: int = C.TOP_N, sep: str | None = None) -> DataFrame:
    """(weekday, hour, cells): cell names in rank order."""
    return ranked_index(profitable_areas(trips, n), ("weekday", "hour"), "cell", "cells", sep=sep)
