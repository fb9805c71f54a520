"""Every query with SQL against its SQL, on the smallest tables."""

import pytest
from conftest import same_rows

from typeweave.jobs.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() >= 1


def test_entry_has_core_queries():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
