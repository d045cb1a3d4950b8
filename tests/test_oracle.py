"""Every registered query against its SQL."""

import pytest
from oracle import connect, differences

import __spark_entry__ as contract

FIXED_NAMES = set(contract.queries())


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, folder, con, name):
    assert differences(contract.queries()[name](spark, folder), con,
                       contract.oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= FIXED_NAMES


def test_entry(spark):
    assert contract.entry(spark).count() > 0
