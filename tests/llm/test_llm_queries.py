"""Every training-data query that SQL can express against its SQL."""

from __future__ import annotations

import pytest
from compare import assert_same
from sparklog.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
