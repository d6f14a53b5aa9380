"""The operator queries that SQL can express."""

import pytest

from stemma.llm import queries
from tests.oracle import agree, needs_tables


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
