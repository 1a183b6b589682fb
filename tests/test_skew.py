"""A hot key holding a third of all trips gives exact results on many partitions."""

from pyspark.sql import functions as F

from cabgrid.plans import frequent_routes, profitable_areas

SCHEMA = (
    "pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, pickup_longitude double, pickup_latitude double, "
    "dropoff_longitude double, dropoff_latitude double, fare_amount decimal(12,2), tip_amount decimal(12,2)"
)
X0, Y0, DX, DY = -74.913585, 41.474937, 0.005986, 0.004491556


def _trips(spark, n=30000):
    """n trips; the first third share one route, hour and drop-off cell."""
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id") % 4000).alias("r"),
    )
    base = F.to_timestamp_ntz(F.lit("2024-01-08 08:50:00"))  # a monday
    return df.select(
        base.alias("pickup_ts"),
        base.alias("dropoff_ts"),
        (F.lit(X0) + F.lit(DX) * (F.lit(100) + F.col("r") % 50)).alias("pickup_longitude"),
        (F.lit(Y0) - F.lit(DY) * (F.lit(100) + (F.col("r") / 50).cast("int"))).alias("pickup_latitude"),
        (F.lit(X0) + F.lit(DX) * (F.lit(150) + F.col("r") % 7)).alias("dropoff_longitude"),
        F.lit(Y0 - DY * 150).alias("dropoff_latitude"),
        F.lit(10).cast("decimal(12,2)").alias("fare_amount"),
        (F.col("id") % 3).cast("decimal(12,2)").alias("tip_amount"),
    ).repartition(16)


def test_hot_route_counts_exactly(spark):
    top = frequent_routes(_trips(spark)).orderBy("rank").collect()
    assert len(top) == 10
    assert top[0].trip_count == 10000 + 5  # the hot route, plus its regular share
    assert (top[0].weekday, top[0].hour) == ("monday", "08")
    assert all(a.trip_count >= b.trip_count for a, b in zip(top, top[1:]))


def test_hot_cell_profitability(spark):
    got = profitable_areas(_trips(spark)).orderBy("rank").collect()
    cells = {r.cell: r for r in got}
    # drop-off cells: 7 of them, all trips at minute 50 (both windows)
    assert len(got) == 7
    hot = 10000 + sum(1 for i in range(10000, 30000) if (i % 4000) % 7 == 0)
    assert cells["151.151"].empty_taxis == hot
    assert sum(r.empty_taxis for r in got) == 30000
