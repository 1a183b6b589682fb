"""Trips and raw trip lines derived from the driver's ``events`` table.

The test tables carry no taxi data, so each event becomes one trip: the
event time is the pickup, the drop-off follows 60 to 2,459 s later, and the
coordinates are placed on the grid from the event and user ids, over some
thousands of cells, a quarter of them on one route.  Most lie 0.4 cell or less from a cell centre; some lie
exactly on the study area's bounds (so in cells 0 and 300), some on a cell
edge or a billionth of a degree beside it, and some are zero or outside.
The ``event_id % n`` expressions below only shape values (coordinates and
injected faults); no row is filtered out, so every event becomes one trip (or
one line), and the work scales with the whole ``events`` table.

The same derivations exist as DuckDB SQL in :mod:`cabgrid.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geo import LAT_STEP, LON_STEP


def _eid() -> Column:
    return F.col("event_id")


def _uid() -> Column:
    return F.col("user_id")


def _offset(mult: int) -> Column:
    """Deterministic offset in (-0.40, 0.39) of a cell."""
    return ((_eid() * mult) % 80 - 40).cast("double") / F.lit(100.0)


def _lon(base_cells: Column, mult: int) -> Column:
    return F.lit(C.GRID_X0) + F.lit(LON_STEP) * (base_cells + _offset(mult))


def _lat(base_cells: Column, mult: int) -> Column:
    return F.lit(C.GRID_Y0) - F.lit(LAT_STEP) * (base_cells + _offset(mult))


def _edge(n: int) -> Column:
    """Number of cells to a cell edge."""
    return (F.lit(60) + _eid() % n).cast("double") - F.lit(0.5)


def _beside() -> Column:
    """On the edge, or a billionth of a degree to either side."""
    return (_eid() % 3 - 1).cast("double") * F.lit(1e-9)


def _bound(every: int, low: float, high: float, turn: int) -> Column:
    """One of two bounds, in turns."""
    return F.when(F.expr(f"(event_id div {every * turn}) % 2") == 0, F.lit(low)).otherwise(F.lit(high))


def _hot(cells: int, other: Column) -> Column:
    """A quarter of the trips share one route."""
    return F.when(_eid() % 4 == 0, F.lit(cells)).otherwise(other)


def _trip_time() -> Column:
    return (F.lit(60) + (_eid() * 37) % 2400).cast("int")


def _dropoff_ts() -> Column:
    return F.col("ts") + F.expr("INTERVAL 1 SECOND") * _trip_time()


def trips_from_events(events: DataFrame) -> DataFrame:
    """Trip frame with the columns every query reads, plus ``event_id``."""
    eid, uid = _eid(), _uid()
    x0, y0 = F.lit(C.GRID_X0), F.lit(C.GRID_Y0)
    return events.select(
        eid.alias("event_id"),
        uid.cast("string").alias("medallion"),
        F.col("ts").alias("pickup_ts"),
        _dropoff_ts().alias("dropoff_ts"),
        _trip_time().alias("trip_time_in_secs"),
        F.when(eid % 50 == 0, F.lit(0.0))
        .when(eid % 47 == 0, F.lit(-75.5))
        .when(eid % 41 == 0, _bound(41, C.LON_MIN, C.LON_MAX, 1))
        .when(eid % 43 == 0, x0 + F.lit(LON_STEP) * _edge(170) + _beside())
        .otherwise(_lon(_hot(150, F.lit(100) + (uid * 37) % 101), 13))
        .alias("pickup_longitude"),
        F.when(eid % 50 == 0, F.lit(0.0))
        .when(eid % 41 == 0, _bound(41, C.LAT_MIN, C.LAT_MAX, 2))
        .when(eid % 43 == 0, y0 - F.lit(LAT_STEP) * _edge(190) + _beside())
        .otherwise(_lat(_hot(160, F.lit(110) + (uid * 53) % 83), 29))
        .alias("pickup_latitude"),
        F.when(eid % 53 == 0, F.lit(0.0))
        .when(eid % 61 == 0, _bound(61, C.LON_MIN, C.LON_MAX, 1))
        .when(eid % 67 == 0, x0 + F.lit(LON_STEP) * _edge(150) + _beside())
        .otherwise(_lon(_hot(153, F.lit(120) + (uid * 11 + eid % 5) % 97), 17))
        .alias("dropoff_longitude"),
        F.when(eid % 59 == 0, F.lit(42.5))
        .when(eid % 61 == 0, _bound(61, C.LAT_MIN, C.LAT_MAX, 2))
        .when(eid % 67 == 0, y0 - F.lit(LAT_STEP) * _edge(160) + _beside())
        .otherwise(_lat(_hot(164, F.lit(130) + (uid * 7 + eid % 3) % 71), 31))
        .alias("dropoff_latitude"),
        F.col("value").cast("decimal(12,2)").alias("fare_amount"),
        (eid % 7).cast("int").cast("decimal(12,2)").alias("tip_amount"),
    )


def trip_lines_from_events(events: DataFrame) -> DataFrame:
    """Raw 17-field text lines ``(event_id, value)``, some of them faulty.

    Every 61st line is empty, every 67th is short, every 71st has a bad
    pickup longitude; some carry zero coordinates, blanks around numbers,
    money with more than two decimals, or date-times of another form (no
    time, a zone, one-digit parts).
    """
    eid, uid = _eid(), _uid()
    money = F.col("value").cast("decimal(12,2)")

    def text19(ts: Column) -> Column:
        return F.substring(ts.cast("string"), 1, 19)

    def digits(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    begin = text19(F.col("ts"))
    pickup = (
        F.when(eid % 101 == 0, F.substring(begin, 1, 10))
        .when(eid % 103 == 0, F.concat(begin, F.lit("+05:00")))
        .when(eid % 107 == 0, F.lit("2013-1-1 5:50:00"))
        .otherwise(begin)
    )
    fare = (
        F.when(eid % 73 == 0, F.concat(F.lit("  "), money.cast("string"), F.lit(" ")))
        .when(eid % 79 == 0, F.lit("12.345"))
        .when(eid % 83 == 0, F.lit("12345678901.00"))
        .otherwise(money.cast("string"))
    )
    record = F.concat(
        F.lit("m"), uid.cast("string"), F.lit(",h"), uid.cast("string"), F.lit(","),
        pickup, F.lit(","), text19(_dropoff_ts()), F.lit(","),
        _trip_time().cast("string"), F.lit(",1.50,"),
        F.when(eid % 50 == 0, F.lit("0.000000"))
        .when(eid % 71 == 0, F.lit("bad"))
        .when(eid % 89 == 0, digits(" -73.98", F.lit(1000) + eid % 9000))
        .otherwise(digits("-73.98", F.lit(1000) + eid % 9000)),
        F.lit(","), digits("40.75", F.lit(1000) + uid), F.lit(","),
        F.when(eid % 53 == 0, F.lit("0.000000")).otherwise(digits("-73.96", F.lit(1000) + eid % 7000)),
        F.lit(","), digits("40.76", F.lit(1000) + eid % 5000), F.lit(",CSH,"),
        fare, F.lit(",0.50,0.50,"), (eid % 7).cast("string"), F.lit(".00,0.00,"),
        (money + F.lit(1)).cast("string"),
    )
    line = (
        F.when(eid % 61 == 0, F.lit(""))
        .when(eid % 67 == 0, F.lit("short,row"))
        .otherwise(record)
    )
    return events.select(eid.alias("event_id"), line.alias("value"))
