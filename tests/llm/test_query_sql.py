"""The operators' queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from compare import assert_same

from veldra.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
