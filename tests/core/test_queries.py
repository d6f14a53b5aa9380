"""Every core query against its SQL."""

import pytest

import __spark_entry__ as driver
from stemma.plans import queries
from tests.oracle import agree, needs_tables


def test_every_query_has_its_sql():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES) <= set(driver.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    agree(spark, driver.queries()[name], queries.ORACLE_SQL[name])


@needs_tables
def test_entry(spark):
    assert driver.entry(spark).count() > 0
