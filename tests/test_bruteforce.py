"""Q1 and Q2 against a plain-Python brute force on random small trip sets."""

import datetime as dt
import math
from collections import Counter, defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cabgrid.plans import frequent_routes, profitable_areas

SCHEMA = (
    "pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, pickup_longitude double, pickup_latitude double, "
    "dropoff_longitude double, dropoff_latitude double, fare_amount decimal(12,2), tip_amount decimal(12,2)"
)

# A few cells around the middle of the grid, so routes and cells repeat;
# plus zero and out-of-area values.
LONS = st.one_of(
    st.sampled_from([0.0, -75.0, -74.916578, -73.120784]),
    st.integers(140, 143).map(lambda i: -74.913585 + 0.005986 * i) | st.floats(-74.2, -74.0),
)
LATS = st.one_of(
    st.sampled_from([0.0, 42.0, 41.477183, 40.129716]),
    st.integers(150, 152).map(lambda i: 41.474937 - 0.004491556 * i) | st.floats(40.6, 40.8),
)
TIMES = st.datetimes(dt.datetime(2013, 1, 1), dt.datetime(2013, 1, 15)).map(lambda t: t.replace(microsecond=0))
MONEY = st.integers(0, 5000).map(lambda c: Decimal(c) / 100)
TRIP = st.tuples(TIMES, st.integers(0, 3600), LONS, LATS, LONS, LATS, MONEY, MONEY)


def _valid(t):
    plon, plat, dlon, dlat = t[2:6]
    box = lambda lat, lon: -74.916578 <= lon <= -73.120784 and 40.129716 <= lat <= 41.477183
    return 0 not in (plon, plat, dlon, dlat) and box(plat, plon) and box(dlat, dlon)


def _cell(lat, lon):
    x = 1 + math.floor(1 / 2 + (lon - -74.913585) / 0.005986)
    y = 1 + math.floor(1 / 2 + (41.474937 - lat) / 0.004491556)
    return f"{x}.{y}"


def _key(ts):
    return ts.strftime("%A").lower(), f"{ts.hour:02d}"


def brute_routes(trips, n=10):
    counts = Counter()
    for t in filter(_valid, trips):
        counts[(*_key(t[0]), f"{_cell(t[3], t[2])}-{_cell(t[5], t[4])}")] += 1
    groups = defaultdict(list)
    for (w, h, r), c in counts.items():
        groups[(w, h)].append((-c, r))
    out = set()
    for (w, h), items in groups.items():
        for rank, (neg, r) in enumerate(sorted(items)[:n], 1):
            out.add((w, h, r, -neg, rank))
    return out


def brute_areas(trips, n=10):
    empty, rev, late = Counter(), defaultdict(Decimal), Counter()
    for t in filter(_valid, trips):
        drop = t[0] + dt.timedelta(seconds=t[1])
        key = (*_key(drop), _cell(t[5], t[4]))
        if drop.minute >= 30:
            empty[key] += 1
        if drop.minute >= 45:
            rev[key] += t[6] + t[7]
            late[key] += 1
    groups = defaultdict(list)
    for key in late:
        mean = float(rev[key]) / late[key]
        groups[key[:2]].append((-(mean / empty[key]), key[2], empty[key], mean))
    out = set()
    for (w, h), items in groups.items():
        for rank, (neg, cell, e, mean) in enumerate(sorted(items)[:n], 1):
            out.add((w, h, cell, e, mean, -neg, rank))
    return out


def _frame(spark, trips):
    rows = [(t[0], t[0] + dt.timedelta(seconds=t[1]), *t[2:]) for t in trips]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@settings(
    max_examples=12,
    deadline=None,
    derandomize=True,
    database=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(TRIP, min_size=1, max_size=120))
def test_routes_match_brute_force(spark, trips):
    got = {tuple(r) for r in frequent_routes(_frame(spark, trips)).collect()}
    assert got == brute_routes(trips)


@settings(
    max_examples=12,
    deadline=None,
    derandomize=True,
    database=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(TRIP, min_size=1, max_size=120))
def test_areas_match_brute_force(spark, trips):
    got = {tuple(r) for r in profitable_areas(_frame(spark, trips)).collect()}
    assert got == brute_areas(trips)
