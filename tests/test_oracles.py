"""Every query of the engine's own operators against DuckDB, on whole tables."""

from __future__ import annotations

import pytest
from compare import differences, tables

from inkwell.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_agrees_with_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    assert not differences(df, catalogue.oracle_sql()[name], con)


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup", "class_balance", "multi_query_merge", "selection_quotas"])
def test_partitioning_does_not_matter(spark, name):
    query, found = catalogue.queries()[name], []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, query(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]


def test_plans_prune_columns(spark):
    plan = catalogue.queries()["exact_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "lang" not in plan.split("ReadSchema")[1]
