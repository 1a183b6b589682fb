"""k-means stands: invariants (no SQL oracle exists for a fitted model)."""

import math
import os
import random

from pyspark.sql import functions as F

import pytest

from cabgrid.functions import valid_trips
from cabgrid.operators import fit_stands, laid_out_points, stand_lines, sweep_stands
from cabgrid.operators import stands as stands_module
from cabgrid.plans import taxi_stands
from cabgrid.sinks import write_stand_lines
from cabgrid.sources import trips_from_events

from conftest import SF_SMALL

GROUPS = [(40.70, -74.00), (40.80, -73.90), (40.60, -73.80)]


def _groups(spark):
    rows = []
    for gi, (lat, lon) in enumerate(GROUPS):
        for j in range(30):
            rows.append((lat + (j % 5) * 1e-4, lon + (j // 5) * 1e-4))
    return spark.createDataFrame(rows, "pickup_latitude double, pickup_longitude double")


def test_three_groups_found(spark):
    with sweep_stands(_groups(spark), ks=(3,)) as sweep:
        centres = sorted((round(r.latitude, 2), round(r.longitude, 2)) for r in sweep.centres().collect())
        assert centres == sorted(GROUPS)
        load = sorted(r.trips for r in sweep.assignment().collect())
        assert load == [30, 30, 30]
    assert not sweep.points.is_cached


def test_points_go_to_nearest_centre_and_sse_matches(spark):
    trips = trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    sweep = taxi_stands(trips, ks=(5,))
    try:
        centres = {(r.k, r.stand_id): (r.latitude, r.longitude) for r in sweep.centres().collect()}
        assert sum(1 for k, _ in centres if k == 5) == 5
        own = sweep.predicted(5).collect()
        total = 0.0
        for r in own:
            d = {i: (r.latitude - c[0]) ** 2 + (r.longitude - c[1]) ** 2 for (k, i), c in centres.items() if k == 5}
            assert math.isclose(d[r.stand_id], min(d.values()), rel_tol=1e-9, abs_tol=1e-15)
            total += d[r.stand_id] * r.trips
        sse = {r.k: r.sse for r in sweep.sse().collect()}
        assert math.isclose(sse[5], total, rel_tol=1e-6)
        n = sum(r.trips for r in own)
        lat = sum(r.latitude * r.trips for r in own) / n
        lon = sum(r.longitude * r.trips for r in own) / n
        assert sse[5] <= sum(((r.latitude - lat) ** 2 + (r.longitude - lon) ** 2) * r.trips for r in own)
        per_stand = sweep.assignment().where("k = 5").agg(F.sum("trips"), F.sum("sse")).first()
        assert per_stand[0] == n == valid_trips(trips).count()
        assert math.isclose(per_stand[1], sse[5], rel_tol=1e-9)
        facts = sweep.facts().first()
        assert (facts.k, facts.stands, facts.trips, facts.all_nearest, facts.no_worse_than_one) == (5, 5, n, True, True)
    finally:
        sweep.release()


def test_same_seed_same_centres(spark):
    pts = _groups(spark).repartition(2)
    a = sweep_stands(pts, ks=(4,), seed=7)
    b = sweep_stands(pts, ks=(4,), seed=7)
    try:
        ca = sorted(tuple(r) for r in a.centres().collect())
        cb = sorted(tuple(r) for r in b.centres().collect())
        assert ca == cb
    finally:
        a.release()
        b.release()


def test_stand_files(spark, scratch):
    sweep = sweep_stands(_groups(spark), ks=(2, 3))
    try:
        lines = stand_lines(sweep.centres())
        write_stand_lines(lines, scratch)
    finally:
        sweep.release()
    for k in (2, 3):
        folder = os.path.join(scratch, f"k={k}")
        text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
        rows = text.strip().split("\n")
        assert len(rows) == k
        for row in rows:
            lat, lon = row.split(",")
            assert len(lat.split(".")[1]) == 8 and len(lon.split(".")[1]) == 8


def _events(spark):
    return valid_trips(trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet")))


def _result(trips, **how):
    with sweep_stands(trips, ks=(5, 31), **how) as sweep:
        centres = sorted(tuple(r) for r in sweep.centres().collect())
        return centres, sorted(tuple(r) for r in sweep.sse().collect())


def _close(a, b):
    return len(a) == len(b) and all(
        x[:-2] == y[:-2] and all(math.isclose(u, v, rel_tol=1e-9) for u, v in zip(x[-2:], y[-2:])) for x, y in zip(a, b)
    )


def test_stands_do_not_depend_on_the_input_split(spark):
    """Also not on the shuffle's own partition count (as on another cluster)."""
    base = _result(_events(spark))
    for parts in (1, 4, 16):
        got = _result(_events(spark).repartition(parts))
        assert _close(base[0], got[0]) and _close(base[1], got[1]), parts
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = _result(_events(spark), parallelism=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert _close(base[0], got[0]) and _close(base[1], got[1])


CORES = """
import sys
sys.path.insert(0, sys.argv[1])
from cabgrid.functions import valid_trips
from cabgrid.operators import sweep_stands
from cabgrid.session import local_session
from cabgrid.sources import trips_from_events
spark = local_session(sys.argv[2], 4)
with sweep_stands(valid_trips(trips_from_events(spark.read.parquet(sys.argv[3]))), ks=(5,)) as s:
    for r in sorted(tuple(r) for r in s.centres().collect()):
        print("STAND", *r)
spark.stop()
"""


def test_stands_do_not_depend_on_cores():
    import subprocess
    import sys

    from conftest import ROOT

    seen = []
    for cores in ("2", "5"):
        args = [sys.executable, "-c", CORES, ROOT, cores, f"{SF_SMALL}/events.parquet"]
        out = subprocess.run(args, capture_output=True, text=True, timeout=300).stdout
        seen.append([tuple(map(float, x.split()[1:])) for x in out.split("\n") if x.startswith("STAND")])
    assert len(seen[0]) == 5 and _close(seen[0], seen[1])


def test_one_copy_of_the_points_is_cached(spark, monkeypatch):
    """Storage during the fits: the shared points, and no blocks beside them."""
    seen = []

    def watched(points, k, seed, **params):
        model = fit_stands(points, k, seed, **params)
        infos = spark.sparkContext._jsc.sc().getRDDStorageInfo()
        seen.append([(i.numCachedPartitions(), i.name()) for i in infos if "features" in i.name() or i.memSize() > 10_000])
        return model

    monkeypatch.setattr(stands_module, "fit_stands", watched)
    with sweep_stands(_events(spark), ks=(3, 5), parallelism=1, partitions=4):
        pass
    assert all(len(x) == 1 and x[0][0] == 4 for x in seen), seen


def test_points_are_released_when_a_fit_fails(spark, monkeypatch):
    kept = []

    def fails(points, k, seed, **params):
        kept.append(points)
        raise RuntimeError("no fit")

    monkeypatch.setattr(stands_module, "fit_stands", fails)
    with pytest.raises(RuntimeError, match="no fit"):
        sweep_stands(_groups(spark), ks=(3,))
    assert kept and not kept[0].is_cached


def test_layout_is_fixed_and_weights_count_every_trip(spark):
    trips = _groups(spark).union(_groups(spark))
    pts = laid_out_points(trips, 5)
    assert pts.rdd.getNumPartitions() == 5
    assert pts.count() == 90 and pts.agg(F.sum("trips")).first()[0] == 180


def test_concurrent_fits_equal_sequential_fits(spark):
    trips = trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    pts = valid_trips(trips)
    with sweep_stands(pts, ks=(3, 7, 11)) as together, sweep_stands(pts, ks=(3, 7, 11), parallelism=1) as alone:
        a = sorted(tuple(r) for r in together.centres().collect())
        b = sorted(tuple(r) for r in alone.centres().collect())
    assert a == b


def test_layout_follows_the_number_of_points():
    assert [stands_module.layout_size(n) for n in (0, 1, 2_000_000, 2_000_001, 10**9)] == [8, 8, 8, 9, 4000]


def test_default_layout_equals_the_same_count_given(spark):
    with sweep_stands(_events(spark), ks=(5,)) as a, sweep_stands(_events(spark), ks=(5,), partitions=8) as b:
        assert a.points.rdd.getNumPartitions() == 8
        assert sorted(tuple(r) for r in a.centres().collect()) == sorted(tuple(r) for r in b.centres().collect())


def test_layout_is_reachable_from_answers_and_command_line(spark, scratch, monkeypatch):
    from cabgrid import __main__ as cli
    from cabgrid.plans import answers, questions

    seen = []
    real = questions.taxi_stands
    monkeypatch.setattr(questions, "taxi_stands", lambda *a, **b: seen.append(b.get("partitions")) or real(*a, **b))
    answers.write_answers(_events(spark), f"{scratch}/out", which=(3,), ks=(2,), stand_partitions=3)
    line = "a,b,2013-01-01 00:00:00,2013-01-01 00:02:00,1,0.4,-73.9{},40.7{},-73.96,40.71,CSH,3.50,0,0,0,0,4"
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/trips.csv", "w") as f:
        f.write("\n".join(line.format(i, i) for i in range(10, 30)))
    cli.main([f"{scratch}/in", f"{scratch}/cli", "--questions", "3", "--ks", "2", "--stand-partitions", "5"])
    assert seen == [3, 5]


def test_costs_by_prediction_equal_costs_of_the_nearest_stand(spark):
    with sweep_stands(_events(spark), ks=(5, 31)) as sweep:
        own = {r.k: r.sse for r in sweep.sse().collect()}
        near = {r.k: r.sse for r in stands_module.sse(sweep.unpacked(), sweep.centres()).collect()}
        parts = {r.k: r.s for r in sweep.assignment().groupBy("k").agg(F.sum("sse").alias("s")).collect()}
    assert own.keys() == near.keys() == {5, 31}
    assert all(math.isclose(own[k], near[k], rel_tol=1e-9) and math.isclose(own[k], parts[k], rel_tol=1e-9) for k in own)


def test_lines_round_by_the_exact_binary_value(spark):
    """Also where the ninth decimal is 5: exact ties go to the even digit."""
    rnd = random.Random(1)
    values = [40.827956875, 0.1 + 0.2, -74.913585, 2.0**-9, 3 * 2.0**-9, -5e-10, 0.125, 1.000000015, -73.999999995]
    values += [40 + i / 10**9 for i in range(5, 2000, 10)] + [rnd.randrange(10**10, 10**12) / 10**10 for _ in range(2000)]
    values += [rnd.randrange(10**9) / 10**9 - 74 for _ in range(2000)]
    centres = spark.createDataFrame([(1, i, v, -v) for i, v in enumerate(values)], "k int, stand_id int, latitude double, longitude double")
    got = {r.stand_id: r.line for r in stand_lines(centres).collect()}
    assert got == {i: f"{v:.8f},{-v:.8f}" for i, v in enumerate(values)}
