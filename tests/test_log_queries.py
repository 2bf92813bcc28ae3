"""Every log query against its SQL."""

from __future__ import annotations

import pytest
from compare import assert_same
from sparklog import queries, queries_service

SF = "/root/testdata/sf0.001"
assert queries_service


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).columns
