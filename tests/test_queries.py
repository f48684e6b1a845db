"""Every registered relational query against its SQL."""

import pytest
from conftest import SF, same_rows
from sluice.plans.queries import ORACLES, QUERIES


def test_all_have_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
