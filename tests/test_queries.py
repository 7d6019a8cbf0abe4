"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, name):
    oracles = entry.oracle_sql()
    assert name in oracles
    assert difference(spark, connect(SF), SF, entry.queries()[name], oracles[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "delay_since_last_nanos", "url", "source"]
    assert df.count() > 0
