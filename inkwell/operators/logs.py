"""Append-only logs, caches and spending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The last row of each key. Aggregates, so a busy key combines before the
    shuffle."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in log.columns])


def missing(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose key the cache lacks."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def within_budget(items: DataFrame, cost: Column, cap: float, *order: str, group: str | None = None) -> DataFrame:
    """Adds spent_before and skipped: in order, an item is asked for while
    what was spent before it is below the cap."""
    base = W.partitionBy(group) if group else W.partitionBy(F.lit(1))
    before = F.sum(cost).over(base.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    out = items.withColumn("spent_before", F.coalesce(before, F.lit(0.0)))
    return out.withColumn("skipped", F.col("spent_before") >= cap)


def affordable(items: DataFrame, each: float, cap: float) -> DataFrame:
    """The estimate for all items, and whether the cap covers it."""
    return items.agg(F.count(F.lit(1)).alias("items")).withColumn("estimate", F.col("items") * each).withColumn("affordable", F.col("estimate") <= cap)


def usage_cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    """Spend of tokens at prices per million."""
    return (prompt * price_in + completion * price_out) / F.lit(1e6)


def unlabelled(sheet: DataFrame, log: DataFrame, keys: Sequence[str] = ("query_id", "novel_id")) -> DataFrame:
    """Sheet rows that the log has no label for."""
    return sheet.join(log.select(*keys).distinct(), list(keys), "left_anti")


def next_unlabelled(sheet: DataFrame, log: DataFrame, after: int, *, position: str = "position", keys: Sequence[str] = ("query_id", "novel_id")) -> DataFrame:
    """The first unlabelled row after a position, else the first of all."""
    return unlabelled(sheet, log, keys).orderBy((F.col(position) <= after).cast("int"), position).limit(1)


def filled(sheet: DataFrame, log: DataFrame, keys: Sequence[str] = ("query_id", "novel_id"), seq: str = "seq") -> DataFrame:
    """The sheet with the last labels of the log."""
    names = [c for c in log.columns if c not in (*keys, seq)]
    last = latest(log, keys, seq).drop(seq)
    return sheet.drop(*names).join(last, list(keys), "left")


def judged_pairs(results: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("query_id", "novel_id")) -> DataFrame:
    """Result rows with their verdicts; null where nobody judged."""
    return results.join(verdicts.dropDuplicates(list(keys)), list(keys), "left")


def judging_tasks(results: DataFrame, cache: DataFrame, keys: Sequence[str] = ("query_id", "novel_id")) -> DataFrame:
    """Distinct pairs over all systems that the cache has no verdict for."""
    return results.select(*keys).distinct().join(cache.select(*keys).distinct(), list(keys), "left_anti")
