"""Grid cells, time parts and the validity predicate on hand-made rows."""

import datetime as dt

from conftest import plan_text

from cabgrid.functions import (
    cell_id,
    hour_text,
    in_last_minutes,
    minute_of,
    route_id,
    valid_trips,
    weekday_name,
)


def test_cell_edges(spark):
    # (lat, lon, expected cell)
    rows = [
        (41.474937, -74.913585, "1.1"),  # centre of cell 1.1
        (41.47718, -74.9165, "1.1"),  # just inside the north-west corner
        (41.477183, -74.916578, "0.0"),  # exact corner, still inside the box
        (40.129716, -73.120784, "300.300"),  # south-east corner
        (41.474937 - 0.004491556, -74.913585 + 0.005986, "2.2"),
    ]
    df = spark.createDataFrame(rows, "lat double, lon double, want string")
    got = df.select(cell_id("lat", "lon").alias("cell"), "want").collect()
    assert [r.cell for r in got] == [r.want for r in got]


def test_route_id(spark):
    df = spark.createDataFrame([("150.160", "153.164")], "p string, d string")
    assert df.select(route_id("p", "d")).first()[0] == "150.160-153.164"


def test_time_parts(spark):
    ts = [dt.datetime(2013, 1, 1, 0, 2, 0), dt.datetime(2013, 3, 10, 2, 30, 0), dt.datetime(2024, 1, 7, 23, 59, 59)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    got = df.select(weekday_name("ts"), hour_text("ts"), minute_of("ts")).collect()
    assert [tuple(r) for r in got] == [("tuesday", "00", 2), ("sunday", "02", 30), ("sunday", "23", 59)]


def test_time_parts_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(dt.datetime(2013, 3, 10, 2, 30, 0),)], "ts timestamp_ntz")
        assert tuple(df.select(weekday_name("ts"), hour_text("ts")).first()) == ("sunday", "02")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_minute_windows(spark):
    minutes = [29, 30, 44, 45, 59]
    df = spark.createDataFrame([(dt.datetime(2013, 1, 1, 10, m),) for m in minutes], "dropoff_ts timestamp_ntz")
    assert df.where(in_last_minutes("dropoff_ts", 30)).count() == 4
    assert df.where(in_last_minutes("dropoff_ts", 45)).count() == 2


def test_valid_trip_predicate(spark):
    good = (-73.956528, 40.716976, -73.962440, 40.715008)
    rows = [
        good,
        (0.0, 0.0, -73.96, 40.71),  # pickup at 0,0
        (-73.95, 40.71, -73.96, 42.5),  # drop-off latitude outside the box
        (None, 40.71, -73.96, 40.71),  # unparsable longitude
        (-74.916578, 41.477183, -73.120784, 40.129716),  # both box corners: inside
        (-74.916579, 41.0, -73.5, 41.0),  # just west of the box
    ]
    schema = "pickup_longitude double, pickup_latitude double, dropoff_longitude double, dropoff_latitude double"
    df = spark.createDataFrame(rows, schema)
    kept = [tuple(r) for r in valid_trips(df).collect()]
    assert kept == [good, (-74.916578, 41.477183, -73.120784, 40.129716)]


def test_valid_filter_reaches_parquet_scan(spark, scratch):
    path = scratch
    spark.createDataFrame(
        [(-73.95, 40.71, -73.96, 40.72, 1)],
        "pickup_longitude double, pickup_latitude double, dropoff_longitude double, "
        "dropoff_latitude double, extra int",
    ).write.parquet(path)
    df = valid_trips(spark.read.parquet(path)).select("pickup_longitude")
    plan = plan_text(df)
    pushed = [ln for ln in plan.splitlines() if ln.startswith("PushedFilters")]
    assert pushed and "GreaterThanOrEqual(pickup_longitude,-74.916578)" in pushed[0]
    read_schema = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema")][0]
    assert "extra" not in read_schema


def test_weekday_number_path_names_all_days(spark):
    from cabgrid.functions.timeparts import day_number, weekday_from_number

    days = [dt.datetime(2024, 1, d, 12, 0) for d in range(1, 8)]
    df = spark.createDataFrame([(t,) for t in days], "ts timestamp_ntz")
    got = df.select(weekday_name("ts").alias("a"), weekday_from_number(day_number("ts")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert sorted(r.a for r in got) == sorted(
        ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    )


def test_strict_cells_drop_the_corner_cell(spark):
    from cabgrid.functions import cell_id

    corner = (-74.916578, 41.477183, -73.5, 41.0)  # pickup maps to cell 0.0
    inner = (-74.0, 41.0, -73.5, 41.0)
    schema = "pickup_longitude double, pickup_latitude double, dropoff_longitude double, dropoff_latitude double"
    df = spark.createDataFrame([corner, inner], schema)
    assert df.select(cell_id("pickup_latitude", "pickup_longitude")).first()[0] == "0.0"
    assert valid_trips(df).count() == 2
    assert [tuple(r) for r in valid_trips(df, strict_cells=True).collect()] == [inner]
