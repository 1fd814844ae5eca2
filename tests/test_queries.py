"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from storelens.oracle import ORACLE as SQL
from storelens.queries import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    left, right, difference = compare(spark, con, QUERIES[name], SQL[name], folder)
    assert difference is None
    assert left == right


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0 and "store_url" in rows.columns


def test_contract_holds_all_queries():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())
