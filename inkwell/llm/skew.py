"""Joins that stay even where one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of a key are dealt.
SALTS = 16


def with_totals(rows: DataFrame, keys: Sequence[str], totals: Sequence[Column], spread: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with aggregates over all rows of the same ``keys``.

    The aggregates combine before they are shuffled, and come back to a key's
    rows once for each part of them that there is, so that no task holds all
    of a key. ``spread`` deals the rows into parts. Keys must not be null.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    groups = dealt.groupBy(*keys).agg(*totals, F.collect_set("__salt").alias("__salts"))
    groups = groups.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return dealt.join(groups, [*keys, "__salt"]).drop("__salt")
