"""Every registered query against its oracle."""

import pytest
from compare import difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.engine_queries(), entry.oracle_sql()


def test_every_query_has_an_oracle():
    assert not set(QUERIES) - set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), SF, ORACLES[name]) is None
