"""Registration, the queries with SQL, and the subpackage's isolation."""

import os
import re

import pytest

import __spark_entry__ as E
from cabgrid.llm import queries
from oracle_compare import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    r = compare(queries.QUERIES[name](spark, sf), duck(sf), queries.SQL[name])
    assert r["names"] and r["rows"][0] == r["rows"][1] and r["values"], r["first_diff"]


def test_nothing_else_in_the_library_imports_the_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/cabgrid"):
        if folder.endswith(("/llm", "__pycache__")):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f)).read(), f


@pytest.mark.parametrize("name", ["decontaminate", "pii", "quality", "sharding"])
def test_native_operators_use_no_python_on_data(name):
    source = open(f"{ROOT}/cabgrid/llm/{name}.py").read()
    assert not re.search(r"mapInArrow|mapInPandas|applyIn|udf\(|\.rdd\b|import numpy|import pandas|import pyarrow", source)
