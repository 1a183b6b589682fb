"""Ranking, counting and profitability operators on hand tables and events."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cabgrid.functions import valid_trips
from cabgrid.operators import (
    area_profitability,
    area_profitability_join,
    rank_areas,
    rank_routes,
    top_n_per_group,
)
from cabgrid.operators.routes import route_counts
from cabgrid.sources import trips_from_events

from conftest import SF_ORACLE, SF_SMALL, plan_text


def test_route_ties_break_by_name(spark):
    rows = [("monday", "08", f"1.{i:02d}-2.2", 3) for i in range(12)]
    counts = spark.createDataFrame(rows, "weekday string, hour string, route string, trip_count long")
    got = rank_routes(counts).orderBy("rank").collect()
    assert [r.route for r in got] == [f"1.{i:02d}-2.2" for i in range(10)]
    assert [r.rank for r in got] == list(range(1, 11))


def test_area_cut_and_ties(spark):
    prof = [10.0, 9.0, 9.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.5]
    rows = [("friday", "23", f"c{i:02d}", p) for i, p in enumerate(prof)]
    df = spark.createDataFrame(rows, "weekday string, hour string, cell string, profitability double")
    got = rank_areas(df).orderBy("rank").collect()
    assert [r.cell for r in got] == [f"c{i:02d}" for i in range(10)]


def test_fewer_than_n_items(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "g string, v long")
    got = top_n_per_group(df, ["g"], [F.desc("v")], 10).orderBy("g", "rank").collect()
    assert [(r.g, r.v, r.rank) for r in got] == [("a", 2, 1), ("a", 1, 2), ("b", 5, 1)]


def test_counts_do_not_depend_on_partitioning(spark):
    # 100 trips, 5 routes, one (weekday, hour): exact counts on any layout.
    rows = []
    for i in range(100):
        lon = -74.913585 + 0.005986 * (i % 5)
        rows.append((dt.datetime(2013, 1, 1, 8, 0, i % 60), lon, 41.474937, -74.0, 41.0))
    schema = (
        "pickup_ts timestamp_ntz, pickup_longitude double, pickup_latitude double, "
        "dropoff_longitude double, dropoff_latitude double"
    )
    base = spark.createDataFrame(rows, schema)
    for parts in (1, 2, 4, 8):
        got = route_counts(base.repartition(parts)).collect()
        assert sorted(r.trip_count for r in got) == [20] * 5, parts


def _dropoffs(spark, rows):
    schema = (
        "dropoff_ts timestamp_ntz, dropoff_longitude double, dropoff_latitude double, "
        "fare_amount decimal(12,2), tip_amount decimal(12,2)"
    )
    return spark.createDataFrame(rows, schema)


def test_profitability_definition(spark):
    a = (-74.913585, 41.474937)  # cell 1.1
    b = (-74.913585 + 0.005986, 41.474937)  # cell 2.1, only trips at minutes 30-44
    t = lambda m: dt.datetime(2013, 1, 7, 9, m)  # noqa: E731  (a monday)
    rows = [
        (t(29), *a, Decimal("5.00"), Decimal("0.00")),  # too early for both
        (t(30), *a, Decimal("7.00"), Decimal("1.00")),  # empty taxi only
        (t(45), *a, Decimal("10.00"), Decimal("2.00")),  # both
        (t(59), *a, Decimal("3.00"), Decimal("1.00")),  # both
        (t(40), *b, Decimal("9.00"), Decimal("0.00")),  # empty taxi, no late trip
    ]
    df = _dropoffs(spark, rows)
    for f in (area_profitability, area_profitability_join):
        got = f(df).collect()
        assert len(got) == 1, f.__name__  # cell 2.1 has no late trip
        r = got[0]
        assert (r.weekday, r.hour, r.cell, r.empty_taxis) == ("monday", "09", "1.1", 3)
        assert r.mean_revenue == 8.0 and r.profitability == 8.0 / 3


def test_join_form_equals_single_pass(spark):
    trips = valid_trips(trips_from_events(spark.read.parquet(f"{SF_ORACLE}/events.parquet")))
    a = area_profitability(trips)
    b = area_profitability_join(trips)
    assert a.count() > 1000
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rank_range(spark):
    from cabgrid.plans import frequent_routes

    trips = trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    stats = frequent_routes(trips).groupBy("weekday", "hour").agg(
        F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    bad = stats.where("lo <> 1 OR hi <> n OR hi > 10").count()
    assert bad == 0


def _plan(df):
    return plan_text(df, "simple")


def test_top_k_limits_before_the_exchange(spark):
    from cabgrid.plans import frequent_routes, frequent_routes_index

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        trips = trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
        plan = _plan(frequent_routes(trips))
        index = _plan(frequent_routes_index(trips))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert index.count("Exchange hashpartitioning") == 2  # the index adds none
    # partial top-k on the map side, final after the (weekday, hour) exchange
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_single_pass_profitability_has_one_aggregate_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        trips = trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
        plan = _plan(area_profitability(valid_trips(trips)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1
    assert "partial_count" in plan and "Join" not in plan


def test_join_form_reuses_the_aggregate_partitioning(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trips = trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
        plan = _plan(area_profitability_join(valid_trips(trips)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange per aggregate, none added for the sort-merge join
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2


def test_whole_q1_and_q2_do_not_depend_on_partitioning(spark):
    from cabgrid.plans import frequent_routes, profitable_areas

    trips = trips_from_events(spark.read.parquet(f"{SF_ORACLE}/events.parquet"))
    base_routes = {tuple(r) for r in frequent_routes(trips).collect()}
    base_areas = {tuple(r) for r in profitable_areas(trips).collect()}
    for parts in (2, 4, 8):
        t = trips.repartition(parts)
        assert {tuple(r) for r in frequent_routes(t).collect()} == base_routes, parts
        assert {tuple(r) for r in profitable_areas(t).collect()} == base_areas, parts
