"""Writers: vector indexes, appended logs, keyed reports and run settings."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import check_vectors


def write_table(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Parquet; an existing path is an error unless it may be overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends to a log; rows carry a ``seq``, as files have no order."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose header begins with a byte order mark, for spreadsheets."""
    first = df.columns[0]
    df.withColumnRenamed(first, f"﻿{first}").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_index(vectors: DataFrame, path: str, *, model: str, vector: str = "embedding", overwrite: bool = False) -> None:
    """The vectors, with their keys in the rows, and a one-row description."""
    write_table(check_vectors(vectors, vector), f"{path}/vectors", overwrite=overwrite)
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    about = stored.agg(F.count(F.lit(1)).alias("num_vectors"), F.max(F.size(vector)).alias("embedding_dim"), F.count_distinct(F.size(vector)).alias("dims"))
    about = about.withColumns({"model_name": F.lit(model), "index_type": F.lit("flat inner product"), "created_at": F.current_timestamp()})
    write_table(about, f"{path}/about", overwrite=overwrite)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and description of a stored index."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/about")


def write_report(df: DataFrame, path: str, label: str) -> None:
    """Stores a report under its label; reports of other labels stay."""
    df.withColumn("label", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label").parquet(path)


def write_settings(spark: SparkSession, settings: Mapping[str, object], path: str) -> None:
    """Settings of a run as one line of JSON."""
    line = json.dumps(dict(settings), ensure_ascii=False, sort_keys=True)
    spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("overwrite").text(path)
