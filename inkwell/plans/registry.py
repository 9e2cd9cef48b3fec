"""How queries over the driver's tables and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Gives a table by its name.
Tables = Callable[[str], DataFrame]


class Catalogue:
    """Queries by name, each with the DuckDB SQL of the same result if any."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            query.__doc__ = build.__doc__
            self.queries[build.__name__] = query
            if sql is not None:
                self.sql[build.__name__] = sql
            return build

        return register
