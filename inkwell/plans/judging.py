"""Verdicts of a judge on result rows, within a budget and through a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decide, prompts
from ..functions.answers import parse_judge
from ..operators import logs, profiles
from ..protocols import Completer, complete


#: Tokens of a prompt and of an answer that the estimate takes for each verdict.
ESTIMATE = (2500, 150)


class BudgetExceeded(RuntimeError):
    """The estimate for what the cache lacks is above the cap."""


def tasks(results: DataFrame, queries: DataFrame, texts: DataFrame, *, pinned: DataFrame | None = None, windows: int = profiles.WINDOWS, size: int = profiles.WINDOW) -> DataFrame:
    """One row a pair of all systems: the judge's prompt on its evidence.

    ``texts`` has novel_id and text. ``pinned`` evidence (query_id, novel_id,
    evidence) of an annotation sheet is used as it is. Pairs without evidence
    are left out.
    """
    pairs = results.groupBy("query_id", "novel_id").agg(F.min("title_guess").alias("title_guess"))
    sampled = texts.join(pairs.select("novel_id").distinct(), "novel_id", "left_semi")
    sampled = sampled.select("novel_id", profiles.evidence_with(windows, size)(F.col("novel_id").cast("string"), "text").alias("sampled"))
    rows = pairs.join(sampled, "novel_id", "left").join(queries.select("query_id", "query", "wanted", "unwanted"), "query_id")
    if pinned is not None:
        sheet = pinned.groupBy("query_id", "novel_id").agg(F.min("evidence").alias("given"))
        rows = rows.join(sheet, ["query_id", "novel_id"], "left").withColumn("sampled", F.coalesce(F.nullif("given", F.lit("")), "sampled")).drop("given")
    rows = rows.where(F.coalesce("sampled", F.lit("")) != "").withColumnRenamed("sampled", "evidence")
    return rows.withColumn("prompt", prompts.judge(F.col("query"), F.col("wanted"), F.col("unwanted"), F.col("title_guess"), F.col("evidence")))


def preflight(pending: DataFrame, each: float, cap: float) -> float:
    """The estimate for all pending pairs; BudgetExceeded if the cap does not
    cover it."""
    found = logs.affordable(pending, each, cap).first()
    if found["items"] and not found["affordable"]:
        raise BudgetExceeded(f"{found['items']} verdicts cost about {found['estimate']:.4f}, {cap:.4f} are left; judge fewer pairs, or raise the cap")
    return found["estimate"]


def judge(
    rows: DataFrame, cache: DataFrame, load: Callable[[], Completer], *, price_in: float, price_out: float, cap: float,
    model: str = "", spent: float = 0.0, waves: int = 1, folder: str | None = None,
) -> DataFrame:
    """Adds status, cost, judge_relevance_label, judge_constraint_violation
    and judge_confidence to ``tasks``.

    ``status`` is cached, judged, failed (the request died), unparsed or
    skipped (over budget); only the first two have labels, and the last three
    never count as 0. Raises BudgetExceeded before any request if the estimate
    for all pairs that the cache lacks is above what ``spent`` leaves of the
    cap. ``cost`` is that of the tokens that a completer reports, whether its
    answer can be read or not, and the estimate where it reports none; failed
    requests cost nothing.

    Pairs are dealt into ``waves`` by the hash of their prompt, which are
    asked one after the other and written to ``folder``; once the cost of
    those before reaches the cap, the rest is skipped. One wave needs no
    folder and is asked when the result is.
    """
    keyed = rows.withColumn("cache_key", decide.cache_key(prompt_hash=F.sha2("prompt", 256), model=F.lit(model)))
    known = logs.latest(cache.select("cache_key", "seq", "response"), ["cache_key"]).select("cache_key", F.col("response").alias("known"))
    joined = keyed.join(known, "cache_key", "left")
    each = (ESTIMATE[0] * price_in + ESTIMATE[1] * price_out) / 1e6
    pending = joined.where("known IS NULL")
    preflight(pending, each, cap - spent)
    none = {"prompt_tokens": F.lit(None).cast("long"), "completion_tokens": F.lit(None).cast("long")}
    every = joined.where("known IS NOT NULL").withColumns({"response": F.col("known"), "status": F.lit("cached"), "cost": F.lit(0.0), **none})
    metered = F.when(F.col("prompt_tokens").isNotNull(), logs.usage_cost(F.col("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)), price_in, price_out))
    for n in range(waves):
        some = pending.where(F.pmod(F.xxhash64("cache_key"), F.lit(waves)) == n)
        if spent >= cap:
            every = every.unionByName(some.withColumns({"response": F.lit(None).cast("string"), "status": F.lit("skipped"), "cost": F.lit(0.0), **none}))
            continue
        asked = complete(some, load, usage=True).withColumn("status", F.when(F.col("response").isNull(), "failed").otherwise("judged"))
        asked = asked.withColumn("cost", F.coalesce(metered, F.when(F.col("status") == "judged", F.lit(each)), F.lit(0.0)))
        if waves > 1:
            if folder is None:
                raise ValueError("several waves need a folder")
            asked.write.parquet(f"{folder}/wave-{n}")
            asked = rows.sparkSession.read.schema(asked.schema).parquet(f"{folder}/wave-{n}")
            spent += asked.agg(F.sum("cost")).first()[0] or 0.0
        every = every.unionByName(asked)
    every = every.withColumn("j", parse_judge(F.col("response")))
    lost = F.col("status").isin("judged", "cached") & F.col("j.label").isNull()
    return every.select(
        *rows.columns, "cache_key", "response", F.when(lost, "unparsed").otherwise(F.col("status")).alias("status"), "prompt_tokens", "completion_tokens", "cost",
        F.col("j.label").alias("judge_relevance_label"), F.col("j.violation").alias("judge_constraint_violation"), F.col("j.confidence").alias("judge_confidence"),
    )


def summary(judged: DataFrame) -> DataFrame:
    """How many pairs ended in each way, with their tokens and cost."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return judged.groupBy("status").agg(F.count(F.lit(1)).alias("pairs"), total("prompt_tokens"), total("completion_tokens"), total("cost"))


def attach(results: DataFrame, judged: DataFrame) -> DataFrame:
    """Result rows with the labels of their pairs; null where there are none."""
    labels = judged.select("query_id", "novel_id", "judge_relevance_label", "judge_constraint_violation", "judge_confidence")
    return logs.judged_pairs(results, labels)
