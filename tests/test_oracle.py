"""Every registered query against its SQL equivalent, over the whole small tables."""

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(contract._QUERIES) == set(contract.ORACLES)


@pytest.mark.parametrize("name", contract._QUERIES)
def test_query_equals_sql(spark, duck, name):
    problem, rows = compare(spark, duck, contract.queries()[name], contract.oracle_sql()[name], FOLDER)
    assert problem is None and rows > 0


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
