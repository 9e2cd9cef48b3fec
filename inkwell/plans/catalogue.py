"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, dataset_queries, ranking_queries, text_queries

_PARTS = (corpus_queries.CATALOGUE, ranking_queries.CATALOGUE, dataset_queries.CATALOGUE, text_queries.CATALOGUE)
FLAGSHIP = "multi_query_merge"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
