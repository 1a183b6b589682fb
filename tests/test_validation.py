"""Bad parameters fail fast with a clear message, before any Spark job."""

import pytest

from cabgrid.operators import sweep_stands, top_n_per_group
from cabgrid.operators.areas import area_totals
from cabgrid.streaming import stream_trips


def test_k_below_two_is_rejected(spark):
    pts = spark.createDataFrame([(1.0, 2.0)], "pickup_latitude double, pickup_longitude double")
    with pytest.raises(ValueError, match="at least 2"):
        sweep_stands(pts, ks=(1, 5))


def test_top_n_needs_n_at_least_one(spark):
    df = spark.createDataFrame([("a", 1)], "g string, v long")
    with pytest.raises(ValueError, match="at least 1"):
        top_n_per_group(df, ["g"], ["v"], 0)


def test_profit_window_must_lie_inside_empty_window(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="inside"):
        area_totals(df, empty_from=45, profit_from=30)


def test_unknown_stream_format(spark, scratch):
    with pytest.raises(ValueError, match="unsupported"):
        stream_trips(spark, scratch, fmt="json")
