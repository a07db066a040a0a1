"""Every registered query against its SQL, bit for bit, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.oracle import ORACLE
from checks.queries import QUERIES
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df.columns, df.collect(), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "k", "value_score"]
