"""Answer the three questions for a trip source and store the results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .. import constants as C
from ..functions.quality import valid_trips
from ..operators.stands import stand_lines
from ..session import delete_path
from ..sinks import write_index, write_stand_lines
from ..sources.text import NEEDED
from . import questions



def stage_trips(trips: DataFrame, path: str) -> DataFrame:
    """Write the valid trips, with only the columns the questions read, as Parquet.

    Raw text or CSV is then parsed once however many questions follow, and
    each question reads back just its columns, with its filters pushed into
    the Parquet scan.  The table outlives any executor (unlike a cached frame).
    """
    valid_trips(trips).select(*NEEDED).write.parquet(path)
    return trips.sparkSession.read.parquet(path)


def write_answers(
    trips: DataFrame,
    out_dir: str,
    which: Sequence[int] = (1, 2, 3),
    ks: Sequence[int] = C.STAND_KS,
    index_format: str = "pairs",
    stage: bool | None = None,
    mode: str = "overwrite",
    stand_partitions: int | None = None,
) -> dict:
    """Write Q1/Q2 indexes and Q3 stand files under ``out_dir``.

    Layout: ``query1/``, ``query2/`` (one row per weekday and hour, names in
    rank order), ``query3/k=<k>/`` (``lat,lon`` lines) and ``query3_sse/``
    (CSV ``k,sse``).  ``mode="error"`` refuses to replace any of them.
    ``stand_partitions``: layout of Q3's points (see ``sweep_stands``).
    Returns ``{"sse": {k: sse}}`` when Q3 ran; those are len(ks) numbers, so
    bringing them to the driver is bounded.  With more than one question (or
    ``stage=True``) the trips are first written once under ``out_dir``; that
    copy is deleted after the last question, also when one fails.
    """
    out = out_dir.rstrip("/")
    spark = trips.sparkSession
    if stage is None:
        stage = len(set(which)) > 1
    if not stage:
        return _write(trips, out, which, ks, index_format, mode, stand_partitions)
    staged = f"{out}/_trips-{uuid.uuid4().hex}"
    try:
        return _write(stage_trips(trips, staged), out, which, ks, index_format, mode, stand_partitions)
    finally:
        delete_path(spark, staged)


def _write(trips: DataFrame, out: str, which, ks, index_format: str, mode: str, stand_partitions: int | None) -> dict:
    result: dict = {}
    if 1 in which:
        write_index(questions.frequent_routes_index(trips), f"{out}/query1", index_format, mode)
    if 2 in which:
        write_index(questions.profitable_areas_index(trips), f"{out}/query2", index_format, mode)
    if 3 in which:
        with questions.taxi_stands(trips, ks, partitions=stand_partitions) as sweep:
            write_stand_lines(stand_lines(sweep.centres()), f"{out}/query3", mode)
            rows = sweep.sse().orderBy("k").collect()  # len(ks) rows, computed once
        sse = trips.sparkSession.createDataFrame(rows, "k int, sse double")
        sse.coalesce(1).write.mode(mode).option("header", "true").csv(f"{out}/query3_sse")
        result["sse"] = {r.k: r.sse for r in rows}
    return result
