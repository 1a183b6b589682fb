"""Taxi stands: k-means over pickup points, for several k at once.

Distances are plain Euclidean in degrees on (latitude, longitude), as in the
original study.  Every trip counts: trips are reduced to their distinct
points with a count, and Spark ML minimises the same sum with the count as
weight, on a point set that no longer grows with repeated places.

k-means|| draws its start per partition (Spark ML takes no start from the
caller), so the points are laid out the same way whatever the cluster: a
number of partitions that the caller sets or that follows from the number of
distinct points (:func:`layout_size`), by hash of the point, sorted inside.
The same trips, seed and layout give the same stands on any number of cores
and any input split.

The points are persisted once for the whole sweep; the ``row`` solver fits on
that copy (the ``block`` solver would cache a second one per fit).  Persisted
partitions lost with an executor are recomputed from their lineage.

Costs come out of one pass: a point's stand is the models' own prediction (or
for given centres the nearest in a k-element literal array, bounded by k, not
by the data), and sums of a fixed scale do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .. import constants as C
from ..functions.geo import cell_name, cell_x, cell_y

FEATURES = "features"
WEIGHT = "trips"
POINT_COLS = ("pickup_latitude", "pickup_longitude")
CENTRE_SCHEMA = "k int, stand_id int, latitude double, longitude double"
MICRO = 1_000_000.0  # coordinates are averaged in whole millionths of a degree
EIGHT_DECIMALS = "0.00000000"
COST_UNIT = 1e12  # squared distances are summed in whole units of 1e-12


def _assembled(points: DataFrame, *keep: str) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(POINT_COLS), outputCol=FEATURES)
    return assembler.transform(points).select(*keep, FEATURES)


def stand_points(trips: DataFrame, keep=()) -> DataFrame:
    """Pickup (latitude, longitude) of valid trips as an ML feature vector."""
    return _assembled(trips.select(*keep, *POINT_COLS), *keep)


def counted_points(trips: DataFrame) -> DataFrame:
    """(pickup_latitude, pickup_longitude, trips): the distinct pickup points."""
    return trips.groupBy(*POINT_COLS).agg(F.count(F.lit(1)).alias(WEIGHT))


def layout_size(distinct_points: int) -> int:
    """Partitions for so many points: a function of the data alone."""
    return max(C.STAND_PARTITIONS, -(-distinct_points // C.POINTS_PER_PARTITION))


def laid_out_points(trips: DataFrame, partitions: int) -> DataFrame:
    """(trips, features) of the distinct points in ``partitions`` partitions,
    dealt by hash of the point and sorted inside."""
    return _laid_out(counted_points(trips), partitions)


def _laid_out(counted: DataFrame, partitions: int) -> DataFrame:
    placed = counted.repartition(partitions, *POINT_COLS).sortWithinPartitions(*POINT_COLS)
    return _assembled(placed, WEIGHT)


def _persisted_points(trips: DataFrame, partitions: int | None, storage: StorageLevel) -> DataFrame:
    """The laid-out points, persisted; without ``partitions`` the distinct
    points are counted first (once, from a copy dropped again)."""
    if partitions is not None:
        return laid_out_points(trips, partitions).persist(storage)
    counted = counted_points(trips).persist(storage)
    try:
        points = _laid_out(counted, layout_size(counted.count())).persist(storage)
        try:
            points.count()  # filled while the counted copy is there
        except BaseException:
            points.unpersist()
            raise
        return points
    finally:
        counted.unpersist()


def unpack_points(points: DataFrame, keep=()) -> DataFrame:
    """Feature vectors back to ``latitude`` / ``longitude`` columns."""
    arr = vector_to_array(F.col(FEATURES))
    return points.select(*keep, arr[0].alias("latitude"), arr[1].alias("longitude"))


def fit_stands(points: DataFrame, k: int, seed: int = C.KMEANS_SEED, **params) -> KMeansModel:
    """One k-means model on (trips, features): k-means|| start, Spark ML
    defaults, ``row`` solver (it fits on the persisted points themselves)."""
    km = KMeans(
        k=k, seed=seed, featuresCol=FEATURES, predictionCol="stand_id", weightCol=WEIGHT, solver="row", **params
    )
    return km.fit(points)


# --- assignment and cost against given centres ----------------------------------


def _square(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Squared distance, in this order of operations."""
    return (lat - to_lat) * (lat - to_lat) + (lon - to_lon) * (lon - to_lon)


def _centres_of(centres: DataFrame) -> dict[int, list[tuple[int, float, float]]]:
    """Centres by k, on the driver: sum(ks) rows, whatever the data."""
    out: dict[int, list[tuple[int, float, float]]] = {}
    for r in centres.select("k", "stand_id", "latitude", "longitude").orderBy("k", "stand_id").collect():
        out.setdefault(r.k, []).append((r.stand_id, r.latitude, r.longitude))
    return out


def _nearest(stands: list[tuple[int, float, float]], lat: Column, lon: Column) -> Column:
    """struct<sq, stand_id>: the nearest stand; ties go to the smaller id."""
    known = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(y).alias("y"), F.lit(x).alias("x")) for i, y, x in stands]
    )
    return F.array_min(
        F.transform(known, lambda c: F.struct(_square(lat, lon, c["y"], c["x"]).alias("sq"), c["i"].alias("stand_id")))
    )


def _cost(sq: Column) -> Column:
    """A point's cost, times its trips, in whole units: exact to add up."""
    return F.floor(sq * COST_UNIT).cast("decimal(18,0)") * F.col(WEIGHT).cast("decimal(18,0)")


def _as_degrees(units: Column) -> Column:
    return units.cast("double") / COST_UNIT


def assignment(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(k, stand_id, trips, sse): load and spread of every stand that has any.

    ``points(latitude, longitude, trips)``, ``centres(k, stand_id, latitude,
    longitude)``.
    """
    per_k = [
        F.struct(F.lit(k).alias("k"), _nearest(stands, F.col("latitude"), F.col("longitude")).alias("at"))
        for k, stands in _centres_of(centres).items()
    ]
    if not per_k:
        return points.sparkSession.createDataFrame([], "k int, stand_id int, trips long, sse double")
    near = points.select(WEIGHT, F.inline(F.array(*per_k)))
    return near.groupBy("k", "at.stand_id").agg(
        F.sum(WEIGHT).alias("trips"), _as_degrees(F.sum(_cost(F.col("at.sq")))).alias("sse")
    )


def sse(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(k, sse): one column per k in a single aggregate, then one row per k."""
    known = _centres_of(centres)
    if not known:
        return points.sparkSession.createDataFrame([], "k int, sse double")
    sums = points.agg(
        *[
            F.sum(_cost(_nearest(stands, F.col("latitude"), F.col("longitude"))["sq"])).alias(f"k{k}")
            for k, stands in known.items()
        ]
    )
    rows = [F.struct(F.lit(k).alias("k"), _as_degrees(F.col(f"k{k}")).alias("sse")) for k in known]
    return sums.select(F.inline(F.array(*rows)))


def busiest_cell_centres(trips: DataFrame, ks: Sequence[int] = C.STAND_KS) -> DataFrame:
    """(k, stand_id, latitude, longitude): the mean pickup point of the k
    cells with the most pickups (ties by cell name), for each k.

    A plain choice of stands from the data, to compare a fit with.  Means are
    of whole millionths of a degree, so they do not depend on order.
    """
    micro = lambda c: F.sum(F.floor(F.col(c) * MICRO))
    cells = (
        trips.groupBy(cell_x("pickup_longitude").alias("x"), cell_y("pickup_latitude").alias("y"))
        .agg(
            F.count(F.lit(1)).alias("n"), micro("pickup_latitude").alias("lat"), micro("pickup_longitude").alias("lon")
        )
        .withColumn("cell", cell_name("x", "y"))
    )
    best = cells.orderBy(F.desc("n"), "cell").limit(max(ks))  # a top-k, at most max(ks) rows
    order = Window.orderBy(F.desc("n"), "cell")
    ranked = best.withColumn("stand_id", (F.row_number().over(order) - 1).cast("int"))
    mean = lambda c: F.col(c).cast("double") / F.col("n") / MICRO
    return (
        ranked.select("stand_id", mean("lat").alias("latitude"), mean("lon").alias("longitude"),
                      F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
        .filter(F.col("stand_id") < F.col("k"))
        .select("k", "stand_id", "latitude", "longitude")
    )


# --- the fitted sweep ------------------------------------------------------------


@dataclass
class StandSweep:
    """Models of a k sweep over one persisted point set (trips, features).

    Use as a context manager (or call :meth:`release`) to drop the cache.
    """

    points: DataFrame
    models: dict[int, KMeansModel] = field(default_factory=dict)

    @property
    def spark(self):
        return self.points.sparkSession

    def centres(self) -> DataFrame:
        """(k, stand_id, latitude, longitude); at most sum(ks) rows."""
        rows = [
            (k, i, float(c[0]), float(c[1]))
            for k, m in self.models.items()
            for i, c in enumerate(m.clusterCenters())
        ]
        return self.spark.createDataFrame(rows, CENTRE_SCHEMA)

    def unpacked(self) -> DataFrame:
        """(trips, latitude, longitude) of the distinct points."""
        return unpack_points(self.points, keep=[WEIGHT])

    def predicted(self, k: int) -> DataFrame:
        """(trips, latitude, longitude, stand_id): the model's own assignment."""
        m = self.models[k]
        return unpack_points(m.transform(self.points), keep=[WEIGHT, m.getPredictionCol()])

    def _costs(self) -> DataFrame:
        """(trips, at<k>, sq<k> ...): every point's predicted stand and its
        squared distance, for all ks in one pass."""
        rows = self.points
        for k, m in self.models.items():
            rows = m.copy({m.predictionCol: f"at{k}"}).transform(rows)
        rows = unpack_points(rows, keep=[WEIGHT, *[f"at{k}" for k in self.models]])
        for k, m in self.models.items():
            known = [F.struct(F.lit(float(c[0])).alias("y"), F.lit(float(c[1])).alias("x")) for c in m.clusterCenters()]
            to = F.element_at(F.array(*known), F.col(f"at{k}") + 1)
            rows = rows.withColumn(f"sq{k}", _square(F.col("latitude"), F.col("longitude"), to["y"], to["x"]))
        return rows

    def assignment(self) -> DataFrame:
        """(k, stand_id, trips, sse): load and spread of every stand."""
        each = [
            F.struct(F.lit(k).alias("k"), F.col(f"at{k}").alias("stand_id"), F.col(f"sq{k}").alias("sq"))
            for k in self.models
        ]
        return (
            self._costs().select(WEIGHT, F.inline(F.array(*each))).groupBy("k", "stand_id")
            .agg(F.sum(WEIGHT).alias("trips"), _as_degrees(F.sum(_cost(F.col("sq")))).alias("sse"))
        )

    def sse(self) -> DataFrame:
        """(k, sse): sum of squared distances of all trips to their stand."""
        sums = self._costs().agg(*[F.sum(_cost(F.col(f"sq{k}"))).alias(f"k{k}") for k in self.models])
        rows = [F.struct(F.lit(k).alias("k"), _as_degrees(F.col(f"k{k}")).alias("sse")) for k in self.models]
        return sums.select(F.inline(F.array(*rows)))

    def facts(self) -> DataFrame:
        """(k, stands, trips, all_nearest, no_worse_than_one) of every fit.

        ``trips``: trips the model assigns; ``all_nearest``: every point's
        predicted stand is as near as its nearest one; ``no_worse_than_one``:
        the cost does not exceed that of all trips' mean point.
        """
        lat, lon = F.col("latitude"), F.col("longitude")
        n = F.col(WEIGHT)
        mean = self.unpacked().agg((F.sum(lat * n) / F.sum(n)).alias("y"), (F.sum(lon * n) / F.sum(n)).alias("x")).first()
        out = None
        for k, stands in _centres_of(self.centres()).items():
            at = F.element_at(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for _, y, x in stands]),
                              F.col("stand_id") + 1)
            own = _square(lat, lon, at["y"], at["x"])
            one = _square(lat, lon, F.lit(mean.y), F.lit(mean.x))
            row = self.predicted(k).agg(
                F.lit(len(stands)).cast("long").alias("stands"),
                F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("long").alias("trips"),
                F.coalesce(F.max(own - _nearest(stands, lat, lon)["sq"]) <= 1e-12, F.lit(True)).alias("all_nearest"),
                F.coalesce(F.sum(own * n) <= F.sum(one * n) * (1 + 1e-9), F.lit(True)).alias("no_worse_than_one"),
            ).select(F.lit(k).alias("k"), "*")
            out = row if out is None else out.union(row)
        return out

    def release(self) -> None:
        self.points.unpersist()

    def __enter__(self) -> StandSweep:
        return self

    def __exit__(self, *exc) -> None:
        self.release()


def sweep_stands(
    trips: DataFrame,
    ks: Sequence[int] = C.STAND_KS,
    seed: int = C.KMEANS_SEED,
    storage: StorageLevel = StorageLevel.MEMORY_AND_DISK,
    parallelism: int | None = None,
    partitions: int | None = None,
    **params,
) -> StandSweep:
    """Persist the trips' distinct points once and fit one model per k.

    ``partitions``: the points' layout, on which the start and so the stands
    depend; by default it follows from their number (:func:`layout_size`).

    The fits are independent, so up to ``parallelism`` (default: all ks) run
    as concurrent Spark jobs, as Spark ML's tuning classes do; each fit
    gives the same model as when run alone.  If one fails, the points are
    released.
    """
    ks = [int(k) for k in ks]
    if not ks or any(k < 2 for k in ks):
        raise ValueError("every k must be at least 2 (Spark ML's lower bound)")
    points = _persisted_points(trips, partitions, storage)
    sweep = StandSweep(points)
    try:
        fit = inheritable_thread_target(points.sparkSession)(lambda k: fit_stands(points, k, seed, **params))
        with ThreadPoolExecutor(max_workers=max(1, parallelism or len(ks))) as pool:
            for k, model in zip(ks, pool.map(fit, ks)):
                sweep.models[k] = model
    except BaseException:
        sweep.release()
        raise
    return sweep


def stand_lines(centres: DataFrame) -> DataFrame:
    """(k, stand_id, line) with ``line`` = ``"lat,lon"`` at 8 decimals.

    A coordinate is rounded by the exact binary value of its double, an exact
    tie to the even digit.  (``format_string`` rounds the shortest decimal
    that reads back as the double, half up, so 40.827956875, a little less
    than it looks, would end in 88 instead of 87.)  Within 1e-8 degrees of zero,
    far outside the study area, Java's formatter may round the other way.
    """

    def text(c: str) -> Column:
        return F.call_function("format_number", F.col(c), F.lit(EIGHT_DECIMALS))

    return centres.select("k", "stand_id", F.concat_ws(",", text("latitude"), text("longitude")).alias("line"))
