"""Every registered query against its SQL counterpart on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert differences(got, con.execute(sql).df()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert 0 < df.count() <= 100
    assert df.columns[0] == "reading_id"
