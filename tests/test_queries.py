"""Every registered query against its SQL counterpart, over the whole tables."""

import pytest

import __spark_entry__ as contract
from compare import SMALL, connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", contract.queries())
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, name, SMALL) is None


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_one_row(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 1
    assert len(rows[0]["top_pages"]) == 10
