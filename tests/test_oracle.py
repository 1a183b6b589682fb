"""Every registered query against its DuckDB SQL (sf0.001; sf0.01 via run_oracle.py)."""

import pytest

import __spark_entry__ as E
from cabgrid.plans import catalog
from conftest import SF_SMALL
from oracle_compare import compare, duck

# the training-data operators have their own tests
SQL = {k: v for k, v in E.oracle_sql().items() if k in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql_or_is_iterative():
    assert set(catalog.QUERIES) == set(SQL) | set(catalog.NO_ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(E.queries()[name](spark, SF_SMALL), con, SQL[name])
    assert r["names"], (r["spark_names"], r["duck_names"])
    assert r["rows"][0] == r["rows"][1]
    assert r["values"], r["first_diff"]


@pytest.mark.parametrize("name", ["fixed_stand_lines", "fixed_stand_files"])
def test_stand_text_matches_oracle_at_sf001(spark, name):
    """sf0.01 holds a coordinate whose ninth decimal is a rounded 5."""
    at = "/root/testdata/sf0.01"
    r = compare(E.queries()[name](spark, at), duck(at), SQL[name])
    assert r["rows"] == (111, 111) or r["rows"] == [111, 111]
    assert r["values"], r["first_diff"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["weekday", "hour", "route", "trip_count", "rank"]
    assert df.count() > 600


@pytest.mark.parametrize(
    "name,rows,cols",
    [
        ("taxi_stands", 111, ["k", "stand_id", "latitude", "longitude"]),
        ("stand_lines", 111, ["k", "stand_id", "line"]),
        ("stand_sse", 3, ["k", "sse"]),
        ("stand_files_roundtrip", 111, ["k", "line"]),
    ],
)
def test_rows_only_queries(spark, name, rows, cols):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.columns == cols
    assert df.count() == rows


def test_stand_assignment_covers_every_point(spark):
    df = E.queries()["stand_assignment"](spark, SF_SMALL)
    per_k = {r.k: r.n for r in df.groupBy("k").agg({"trips": "sum"}).withColumnRenamed("sum(trips)", "n").collect()}
    n = catalog.valid_trips(spark, SF_SMALL).count()
    assert per_k == {5: n, 31: n, 75: n}
