"""The queries that SQL can express, against DuckDB on whole tables."""

from __future__ import annotations

import pytest
from compare import differences, tables

from inkwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    assert not differences(queries.queries()[name](spark, sf), queries.oracle_sql()[name], tables(sf))
