"""The logs as streams: an optional addition, as batches do the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, time: str, late: str = "10 minutes") -> DataFrame:
    """A stream of a Parquet log's rows with a watermark."""
    rows = spark.readStream.schema(schema).parquet(path)
    if dict(rows.dtypes)[time] == "timestamp_ntz":
        rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late)


def first_of_key(log: DataFrame, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return log.dropDuplicatesWithinWatermark(list(keys))


def counts(log: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Rows by window and key; a window is out once no row of it can come."""
    return log.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def keep_latest(batch: DataFrame, path: str, keys: list[str], seq: str = "seq") -> None:
    """For ``foreachBatch``: appends the last row of each key of the batch;
    readers take the last of all batches, so a batch that runs twice does no
    harm."""
    from ..operators.logs import latest

    latest(batch, keys, seq).write.mode("append").parquet(path)
