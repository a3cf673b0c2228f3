"""Every registered query that has a SQL twin next to it, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns))
    assert differences(df, con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 45
