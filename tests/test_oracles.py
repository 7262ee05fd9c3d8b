"""Every query against its SQL on the given tables."""

import pytest

import __spark_entry__ as driver
from casework.plans.oracles import ORACLES
from casework.plans.queries import QUERIES
from compare import connect, differences
from conftest import SMALL, interpret


@pytest.fixture(scope="module")
def con(spark):
    interpret(spark, False)
    yield connect(SMALL)
    interpret(spark, True)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= driver.queries().items() and ORACLES.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert differences(df, con, ORACLES[name]) == []


def test_entry(spark):
    row = driver.entry(spark).first()
    assert row["partition_ok"] and row["total"] > 0
