"""Streaming totals equal the batch questions, also after a restart."""

from cabgrid.plans import catalog, frequent_routes, profitable_areas
from cabgrid.sources import read_trips_text
from cabgrid.streaming import (
    area_totals_stream,
    profitable_areas_from_totals,
    route_totals_stream,
    stream_trips,
    top_routes_from_totals,
)

from conftest import SF_SMALL


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_routes_stream_resumes_from_checkpoint(spark, scratch):
    src = catalog.line_file(spark, SF_SMALL)
    totals, _ = route_totals_stream(stream_trips(spark, src, max_files=1))
    assert _same(top_routes_from_totals(totals), frequent_routes(read_trips_text(spark, src)))

    before = sorted(tuple(r) for r in totals.read().collect())

    # more files arrive; the restarted query only reads those and adds them up
    catalog._lines(spark, SF_SMALL).select("value").write.mode("append").text(src)
    again, _ = route_totals_stream(
        stream_trips(spark, src, max_files=1), table=totals.path, checkpoint=totals.checkpoint
    )
    batch = frequent_routes(read_trips_text(spark, src))
    assert _same(top_routes_from_totals(again), batch)
    assert batch.agg({"trip_count": "max"}).first()[0] >= 2
    assert sorted(tuple(r) for r in again.read().collect()) != before


def test_a_reader_sees_whole_batches_only(spark, scratch):
    """A delta being written, or left by a crash, is not part of the table;
    a replayed batch is stored once."""
    src = catalog.line_file(spark, SF_SMALL)
    totals, _ = route_totals_stream(stream_trips(spark, src))
    want = sorted(tuple(r) for r in totals.read().collect())
    delta = totals.read().limit(5)
    delta.write.parquet(f"{totals.path}/open/batch=99")  # a crash before the rename
    assert sorted(tuple(r) for r in totals.read().collect()) == want
    seen = []

    class Watched(type(totals)):
        def _fs(self, path):
            if path.endswith("deltas/batch=7"):  # between the two steps of a trigger
                seen.append(sorted(tuple(r) for r in self.read().collect()))
            return super()._fs(path)

    watched = Watched(spark, totals.path, totals.checkpoint, totals.schema, totals.keys)
    watched.add(delta, 7)
    assert seen == [want]
    more = sorted(tuple(r) for r in totals.read().collect())
    assert more != want
    totals.add(delta, 7)  # a replay
    assert sorted(tuple(r) for r in totals.read().collect()) == more


def test_totals_of_no_batches_are_empty(spark, scratch):
    from cabgrid.streaming.incremental import ROUTE_TOTALS, TotalsTable

    table = TotalsTable(spark, scratch, scratch + "-c", ROUTE_TOTALS, ("weekday", "hour", "route"))
    table.create()
    assert table.read().count() == 0


def test_areas_stream_equals_batch(spark):
    src = catalog.line_file(spark, SF_SMALL)
    totals, _ = area_totals_stream(stream_trips(spark, src, max_files=1))
    assert _same(profitable_areas_from_totals(totals), profitable_areas(read_trips_text(spark, src)))


def test_csv_stream(spark):
    src = catalog.line_file(spark, SF_SMALL)
    totals, _ = route_totals_stream(stream_trips(spark, src, fmt="csv"))
    assert _same(top_routes_from_totals(totals), frequent_routes(read_trips_text(spark, src)))
