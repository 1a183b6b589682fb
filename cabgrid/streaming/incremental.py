"""Q1 and Q2 kept up to date as trip files arrive (Structured Streaming).

The per-key totals behind both questions are additive (route counts; empty
taxis, revenue sum and late-trip count per area).  Every micro-batch
aggregates only its own trips and stores them as one *delta*, the folder
``batch=<id>`` of the totals table; reading the table adds the deltas up.  So
a trigger costs what its files hold, no state is kept, and nothing that was
written is ever rewritten.

A delta is written beside the table and then renamed into it, which is one
step of the file system: a reader sees a batch whole or not at all, also
during a trigger and after a crash between the steps.  A micro-batch that
Spark replays after a restart has the same id and the same trips; if its
delta is already there it is left alone.  (The rename must be atomic, as on
HDFS and local file systems; object stores need a table format instead.)

Progress lives in the checkpoint location (under the shared folder), so a
restarted query resumes where it stopped, and a lost executor only re-runs
its tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.quality import valid_trips
from ..operators import areas, routes
from ..schema import RAW_TEXT_SCHEMA
from ..session import new_table_path
from ..sources.records import trips_from_records, typed_records

ROUTE_TOTALS = "weekday string, hour string, route string, trip_count long"
AREA_TOTALS = (
    "weekday string, hour string, cell string, empty_taxis long, revenue_sum decimal(38,6), revenue_trips long"
)


def stream_trips(spark: SparkSession, source_dir: str, fmt: str = "text", max_files: int | None = None) -> DataFrame:
    """A streaming trip frame over raw record files.

    ``fmt="text"``: plain comma-separated lines (no quoting), as
    :func:`cabgrid.sources.read_trips_text`; ``fmt="csv"``: CSV with quoting.
    """
    if fmt not in ("text", "csv"):
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.readStream.schema(RAW_TEXT_SCHEMA).option("header", "false").option("mode", "PERMISSIVE")
    if fmt == "text":
        reader = reader.option("sep", ",").option("quote", "")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return trips_from_records(typed_records(reader.csv(source_dir)))


@dataclass
class TotalsTable:
    """A table of deltas maintained by a streaming query."""

    spark: SparkSession
    path: str
    checkpoint: str
    schema: str
    keys: tuple[str, ...]

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def create(self) -> None:
        for part in (self._deltas, self._open):
            fs, p = self._fs(part)
            fs.mkdirs(p)

    @property
    def _deltas(self) -> str:
        return f"{self.path}/deltas"

    @property
    def _open(self) -> str:
        return f"{self.path}/open"

    def add(self, delta: DataFrame, batch_id: int) -> None:
        """Store a batch's totals, once."""
        fs, done = self._fs(f"{self._deltas}/batch={batch_id}")
        if fs.exists(done):
            return
        tried = f"{self._open}/batch={batch_id}"
        delta.write.mode("overwrite").parquet(tried)
        if not fs.rename(self._fs(tried)[1], done):
            raise RuntimeError(f"could not store batch {batch_id}")

    def read(self) -> DataFrame:
        """Current totals: the deltas added up."""
        deltas = self.spark.read.schema(self.schema).parquet(self._deltas)
        names = [c for c in deltas.columns if c not in (*self.keys, "batch")]
        return deltas.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in names])


def _run(
    trips: DataFrame, totals_of: Callable, kind: TotalsTable, once: bool
):
    kind.create()

    def write(batch: DataFrame, batch_id: int) -> None:
        kind.add(totals_of(valid_trips(batch)), batch_id)

    writer = trips.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", kind.checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    query = writer.start()
    if once:
        query.awaitTermination()
    return kind, query


def _table(trips: DataFrame, name: str, table, checkpoint, schema: str, key: str) -> TotalsTable:
    spark = trips.sparkSession
    return TotalsTable(
        spark,
        table or new_table_path(spark, f"{name}-totals"),
        checkpoint or new_table_path(spark, f"{name}-checkpoint"),
        schema,
        ("weekday", "hour", key),
    )


def route_totals_stream(
    trips: DataFrame, table: str | None = None, checkpoint: str | None = None, once: bool = True
):
    """Keep (weekday, hour, route, trip_count) for a streaming trip frame."""
    kind = _table(trips, "routes", table, checkpoint, ROUTE_TOTALS, "route")
    return _run(trips, routes.route_counts, kind, once)


def area_totals_stream(
    trips: DataFrame, table: str | None = None, checkpoint: str | None = None, once: bool = True
):
    """Keep (weekday, hour, cell, empty_taxis, revenue_sum, revenue_trips)."""
    kind = _table(trips, "areas", table, checkpoint, AREA_TOTALS, "cell")

    def totals(batch: DataFrame) -> DataFrame:
        return areas.area_totals(batch).withColumn("revenue_sum", F.col("revenue_sum").cast("decimal(38,6)"))

    return _run(trips, totals, kind, once)


def top_routes_from_totals(totals: TotalsTable, n: int = C.TOP_N) -> DataFrame:
    """Q1 on the current route totals."""
    return routes.rank_routes(totals.read(), n)


def profitable_areas_from_totals(totals: TotalsTable, n: int = C.TOP_N) -> DataFrame:
    """Q2 on the current area totals."""
    return areas.rank_areas(areas.profitability_from_totals(totals.read()), n)


__all__ = [
    "stream_trips",
    "TotalsTable",
    "route_totals_stream",
    "area_totals_stream",
    "top_routes_from_totals",
    "profitable_areas_from_totals",
]
