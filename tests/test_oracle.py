"""Every query with a SQL statement gives the rows of that statement."""

import os

import pytest
from oracle import DATA, compare, duck

import __spark_entry__ as entry

FOLDER = f"{DATA}/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_equals_sql(spark, con, name):
    diff, _ = compare(spark, con, QUERIES[name], ORACLE[name], FOLDER)
    assert diff is None, diff


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "source" and df.count() > 0


def test_names():
    assert set(ORACLE) <= set(QUERIES)
