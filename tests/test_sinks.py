"""Sinks and the command line, on files in the shared folder."""

import ast
import glob
import os

from cabgrid.__main__ import main
from cabgrid.plans import catalog, frequent_routes_index
from cabgrid.sinks import preview, write_index
from cabgrid.sources import read_trips_csv, trips_from_events

from conftest import SF_SMALL


def _trips(spark):
    return trips_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))


def _text(folder):
    rows = []
    for f in sorted(glob.glob(os.path.join(folder, "**", "part-*"), recursive=True)):
        rows += [ln for ln in open(f).read().split("\n") if ln]
    return rows


def test_index_formats_round_trip(spark, scratch):
    index = frequent_routes_index(_trips(spark))
    want = sorted((r.weekday, r.hour, ",".join(r.routes)) for r in index.collect())
    write_index(index, f"{scratch}/parquet", fmt="parquet")
    write_index(index, f"{scratch}/json", fmt="json")
    write_index(index, f"{scratch}/text", fmt="text")
    for df in (spark.read.parquet(f"{scratch}/parquet"), spark.read.json(f"{scratch}/json")):
        got = sorted((r.weekday, r.hour, ",".join(r.routes)) for r in df.collect())
        assert got == want
    got = sorted(tuple(ln.split("\t")) for ln in _text(f"{scratch}/text"))
    assert got == want
    assert len(glob.glob(f"{scratch}/text/part-*")) == 1
    write_index(index, f"{scratch}/pairs", fmt="pairs")
    pairs = sorted(ast.literal_eval(ln) for ln in _text(f"{scratch}/pairs"))
    assert [(w, h, ",".join(items)) for (w, h), items in pairs] == want


def test_preview_is_ordered(spark):
    index = frequent_routes_index(_trips(spark), sep=",")
    first = preview(index, ["weekday", "hour"], 3).collect()
    assert [(r.weekday, r.hour) for r in first] == [("friday", "00"), ("friday", "01"), ("friday", "02")]


def test_command_line_writes_all_answers(spark, scratch, capsys):
    src = catalog.line_file(spark, SF_SMALL)
    main([src, f"{scratch}/out", "--format", "csv", "--ks", "2,3"])
    want = frequent_routes_index(read_trips_csv(spark, src))
    want = sorted(((r.weekday, r.hour), list(r.routes)) for r in want.collect())
    assert sorted(ast.literal_eval(ln) for ln in _text(f"{scratch}/out/query1")) == want
    assert len(_text(f"{scratch}/out/query2")) > 0
    assert len(_text(f"{scratch}/out/query3/k=2")) == 2
    assert len(_text(f"{scratch}/out/query3/k=3")) == 3
    sse = spark.read.option("header", "true").csv(f"{scratch}/out/query3_sse")
    assert sorted(int(r.k) for r in sse.collect()) == [2, 3]
    printed = capsys.readouterr().out.strip().split("\n")
    assert len(printed) == 2 and '"k": 2' in printed[0]


def test_stage_trips_keeps_valid_rows_and_needed_columns(spark, scratch):
    from cabgrid.functions import valid_trips
    from cabgrid.plans.answers import stage_trips
    from cabgrid.sources.text import NEEDED

    trips = _trips(spark)
    staged = stage_trips(trips, f"{scratch}/trips")
    assert tuple(staged.columns) == NEEDED
    want = valid_trips(trips).select(*NEEDED)
    assert staged.exceptAll(want).count() == 0 and want.exceptAll(staged).count() == 0


def test_staged_and_direct_answers_agree(spark, scratch):
    from cabgrid.plans.answers import write_answers

    trips = _trips(spark)
    write_answers(trips, f"{scratch}/direct", which=(1, 2), stage=False)
    write_answers(trips, f"{scratch}/staged", which=(1, 2), stage=True)
    for q in ("query1", "query2"):
        assert sorted(_text(f"{scratch}/direct/{q}")) == sorted(_text(f"{scratch}/staged/{q}"))


def test_shared_dir_refuses_a_local_folder_on_a_cluster():
    import pytest

    from cabgrid.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"
        applicationId = "app-1"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_command_line_single_question_from_text(spark, scratch):
    from cabgrid.sources import read_trips_text

    src = catalog.line_file(spark, SF_SMALL)
    main([src, f"{scratch}/one", "--format", "text", "--questions", "2", "--index-format", "text"])
    assert not os.path.exists(f"{scratch}/one/query1") and not os.path.exists(f"{scratch}/one/query3")
    from cabgrid.plans import profitable_areas_index

    exp = profitable_areas_index(read_trips_text(spark, src), sep=",").collect()
    assert sorted(_text(f"{scratch}/one/query2")) == sorted(f"{r.weekday}\t{r.hour}\t{r.cells}" for r in exp)


def test_command_line_preview(spark, scratch, capsys):
    src = catalog.line_file(spark, SF_SMALL)
    main([src, f"{scratch}/pv", "--questions", "1,2", "--preview"])
    printed = capsys.readouterr().out.strip().split("\n")
    assert len(printed) == 2 + 10
    assert printed[0].startswith("(('friday', '00'), [")


def test_staged_trips_are_deleted(spark, scratch):
    """After the answers, and after a failure, nothing is left but answers."""
    import pytest

    from cabgrid.plans.answers import write_answers
    from cabgrid.session import table_count

    before = table_count(spark)
    write_answers(_trips(spark), f"{scratch}/all", ks=(2,))
    assert sorted(os.listdir(f"{scratch}/all")) == ["query1", "query2", "query3", "query3_sse"]
    with pytest.raises(ValueError):
        write_answers(_trips(spark), f"{scratch}/bad", ks=(1,))
    assert sorted(os.listdir(f"{scratch}/bad")) == ["query1", "query2"]
    assert table_count(spark) == before


def test_answers_are_not_replaced_against_the_users_will(spark, scratch):
    import pytest
    from pyspark.errors import AnalysisException

    from cabgrid.plans.answers import write_answers

    write_answers(_trips(spark), f"{scratch}/once", which=(1,), mode="error")
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_answers(_trips(spark), f"{scratch}/once", which=(1,), mode="error")


def test_helper_tables_are_deleted(spark):
    from cabgrid.session import delete_tables, table_count

    before = table_count(spark)
    path = catalog.line_file(spark, SF_SMALL)
    assert os.path.isdir(path) and table_count(spark) == before + 1
    delete_tables(spark, since=before)
    assert not os.path.exists(path) and table_count(spark) == before
