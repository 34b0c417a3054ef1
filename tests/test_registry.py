"""Every registered query with SQL must agree with it on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert (row.segments, row.stored_bytes, row.naive_bytes, row.core_bytes, row.unique_bytes,
            row.partial_bytes) == (1551, 456406, 488033, 0, 426647, 29759)
