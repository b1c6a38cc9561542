import os

import pytest

import __spark_entry__ as contract
from checks import compare, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, name):
    assert compare.compare(spark, compare.connect(SF), name, SF) == ""


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(queries.QUERIES) == set(queries.SQL)
    assert contract.entry(spark).count() > 0
