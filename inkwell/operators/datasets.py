"""Samples, balance, hold-outs and rewards for training sets.

Sampling sorts by a digest of a seed and the row's key, so that a sample is
the same on every run and engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decide
from ..functions.answers import parse_strict, trailing_text
from ..functions.text import strip


def sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows without replacement."""
    return rows.orderBy(decide.shuffled(seed, *[F.col(k) for k in key]), *key).limit(n)


def rank_band(rank: Column) -> Column:
    return F.when(rank.between(1, 3), "1-3").when(rank.between(4, 10), "4-10").otherwise("other")


def stratified_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """An even sample over query and rank band, one row a (query, novel).

    Each stratum gives max(1, n // strata) rows; places left over go to the
    other rows. Of rows that repeat a pair the first by system and rank
    stays.
    """
    first = F.row_number().over(W.partitionBy("query_id", "novel_id").orderBy("system_variant", "rank"))
    one = rows.withColumn("__first", first).where("__first = 1").drop("__first").withColumn("rank_band", rank_band(F.col("rank")))
    draw = decide.shuffled(seed, F.col("query_id"), F.col("novel_id"))
    strata = one.select("query_id", "rank_band").distinct().count()
    each = max(1, n // strata) if strata else 1
    order = W.partitionBy("query_id", "rank_band").orderBy(draw, "novel_id")
    marked = one.withColumns({"__n": F.row_number().over(order), "__d": draw})
    # Chosen rows come first, in the order of their strata; then the rest by the draw.
    chosen = F.col("__n") <= each
    keys = [F.when(chosen, 0).otherwise(1), F.when(chosen, F.col("query_id")), F.when(chosen, F.col("rank_band")), "__d", "novel_id"]
    return marked.orderBy(*keys).limit(n).drop("__n", "__d")


def head_and_tail(rows: DataFrame, head: int, tail: int, seed: int | str, *, group: str = "query_id", rank: str = "pool_rank", key: str = "novel_id") -> DataFrame:
    """By group the rows ranked below ``head`` (from 0), and ``tail`` others."""
    order = W.partitionBy(group, F.col(rank) < head).orderBy(decide.shuffled(seed, F.col(group), F.col(key)), key)
    return rows.withColumn("__n", F.row_number().over(order)).where((F.col(rank) < head) | (F.col("__n") <= tail)).drop("__n")


def balanced(rows: DataFrame, seed: int, *, depth: int = 20, most: int | None = 4, group: str = "query_id", verdict: str = "rule_verdict", rank: str = "pool_rank", key: str = "novel_id") -> DataFrame:
    """As many violating as clean rows of each group, those ranked below
    ``depth`` first; then ``most`` rows of a group at random. Rows without a
    verdict are dropped."""
    rows = rows.where(F.col(verdict).isNotNull())
    draw = decide.shuffled(seed, F.col(group), F.col(key))
    sides = W.partitionBy(group, verdict)
    deep = (F.col(rank) >= depth).cast("int")
    marked = rows.withColumns({"__n": F.row_number().over(sides.orderBy(deep, draw, key)), "__d": draw})
    every = W.partitionBy(group)
    least = F.least(F.count_if(F.col(verdict)).over(every), F.count_if(~F.col(verdict)).over(every))
    kept = marked.withColumn("__least", least).where(F.col("__n") <= F.col("__least"))
    if most is not None:
        again = decide.shuffled(f"{seed}:cap", F.col(group), F.col(key))
        kept = kept.withColumn("__m", F.row_number().over(every.orderBy(again, key))).where(F.col("__m") <= most).drop("__m")
    return kept.drop("__n", "__d", "__least")


def hold_out(rows: DataFrame, share: float, seed: int, *, group: str = "query_id", most: int | None = None) -> DataFrame:
    """Adds split: whole groups are ``val`` or ``train``; at least one is held
    out."""
    n = rows.select(group).distinct().count()
    held = max(1, int(n * share)) if most is None else min(most, max(n // 10, 1))
    chosen = rows.select(group).distinct().orderBy(decide.shuffled(seed, F.col(group)), group).limit(held).withColumn("__val", F.lit(True))
    return rows.join(chosen, group, "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def partner_anchor(rows: DataFrame, *, group: str = "query_id", verdict: str = "rule_verdict", score: str = "ref_score") -> DataFrame:
    """Adds partner_anchor: the mean score of the group's opposite verdict,
    null if it has none."""
    every = W.partitionBy(group)
    mean = lambda flag: F.avg(F.when(F.col(verdict) == flag, F.col(score))).over(every)
    return rows.withColumn("partner_anchor", F.when(F.col(verdict), mean(False)).when(~F.col(verdict), mean(True)))


def exported(rows: DataFrame, source: str, ability: str = "rerank") -> DataFrame:
    """Rows as trainers read them. The verdict is text, so that an abstention
    never becomes false."""
    truth = F.when(F.col("rule_verdict").isNull(), "none").otherwise(F.col("rule_verdict").cast("string"))
    return rows.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct("query", "novel_id", "pool_rank", F.col("constraint_terms"), truth.alias("rule_verdict"), "partner_anchor").alias("extra_info"),
    )


def rewards(rows: DataFrame, text_col: str = "response", finish: str | None = None) -> DataFrame:
    """Adds the reward of each output and its terms.

    ``rows`` has constraint_terms, rule_verdict and partner_anchor. An output
    ends well if nothing follows its object, or by ``finish`` where that is
    known.
    """
    out = rows.withColumns({"__v": parse_strict(F.col(text_col)), "__rest": trailing_text(F.col(text_col))})
    good = F.col("__v.score").isNotNull()
    stopped = F.coalesce(strip(F.col("__rest")) == "", F.lit(False))
    if finish is not None:
        stopped = F.coalesce(F.col(finish) == "stop", stopped)
    rule = F.when(F.size("constraint_terms") > 0, F.col("rule_verdict"))
    claimed = F.coalesce(decide.claims(F.col("__v.violated"), F.col("constraint_terms")), F.lit(False))
    out = out.withColumns(
        {
            "format_ok": good,
            "claimed_violation": good & claimed,
            "r_constraint": F.when(good, decide.constraint_reward(claimed, rule)),
            "r_score": F.when(good, decide.pairwise_reward(F.col("__v.score"), rule, F.col("partner_anchor"))),
            "r_terminate": stopped.cast("double"),
        }
    )
    total = decide.total_reward(F.col("format_ok"), F.col("r_constraint"), F.col("r_score"), F.col("r_terminate"))
    return out.withColumn("reward", total).drop("__v", "__rest")


def score_fields(rows: DataFrame) -> DataFrame:
    """Reward terms without nulls, and flags that tell which were active."""
    return rows.select(
        F.col("reward").alias("score"),
        F.col("format_ok").cast("double").alias("format_ok"),
        F.coalesce("r_constraint", F.lit(0.0)).alias("r_constraint"),
        F.col("r_constraint").isNotNull().cast("double").alias("r_constraint_active"),
        F.coalesce("r_score", F.lit(0.0)).alias("r_score"),
        F.col("r_score").isNotNull().cast("double").alias("r_score_active"),
        "r_terminate",
    )


def tri_state(value: Column) -> Column:
    """A verdict from its text: true, false, or null for anything else."""
    word = F.lower(F.trim(value))
    return F.when(word == "true", True).when(word == "false", False)


def advantages(rows: DataFrame, *, group: str = "group_id", reward: str = "reward") -> DataFrame:
    """Adds advantage: the reward in standard deviations from its group's
    mean, 0 where all rewards are one."""
    every = W.partitionBy(group)
    spread = F.stddev_pop(reward).over(every)
    return rows.withColumn("advantage", F.when(spread * spread <= 1e-12, 0.0).otherwise((F.col(reward) - F.avg(reward).over(every)) / spread))


def length_stats(rows: DataFrame, length: str) -> DataFrame:
    """Median, 95th percentile and maximum: of n lengths in order, counted
    from 0, those at n // 2 and at int(0.95 n), and the last.

    Equal lengths are counted first, so that only the different lengths are
    put in order.
    """
    counts = rows.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    marked = counts.withColumns({"upto": upto, "total": F.sum("n").over(W.partitionBy())})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return marked.agg(at(F.floor(F.col("total") / 2)).alias("median"), at(F.floor(F.col("total") * 0.95)).alias("p95"), F.max("v").alias("max"))


def encoded_pairs(rows: DataFrame, load: Callable[[], Callable[[str], Sequence[int]]], *, most: int, end: int, ignored: int = -100) -> DataFrame:
    """input_ids and labels of (prompt, target); the prompt is masked out of
    the labels, and pairs of more than ``most`` ids are dropped."""

    @F.pandas_udf("input_ids array<int>, labels array<int>")
    def encoded(prompt: pd.Series, target: pd.Series) -> pd.DataFrame:
        encode = load()
        ids, labels = [], []
        for p, t in zip(prompt, target):
            a, b = list(encode(p)), [*encode(t), end]
            ids.append(a + b)
            labels.append([ignored] * len(a) + b)
        return pd.DataFrame({"input_ids": ids, "labels": labels})

    return rows.withColumn("__e", encoded("prompt", "target")).where(F.size("__e.input_ids") <= most).select(*rows.columns, "__e.*")


def padded(ids: Column, size: int, fill: int) -> Column:
    """An array of at least ``size`` elements, filled up at its end."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(ids), F.lit(0))))
