"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, as many times over as
it may repeat. A queued document finishes at the virtual time "words of its
source so far, over the source's target"; the mix is all documents in the
order of that time, cut where the words taken reach the budget. A source's
document that the cut goes through is taken if that brings the source nearer
to its target.

No running sum gathers a source, or all copies, in one task: each source is
cut into 4096 buckets of its shuffled order, and the copies are sorted into
ranges of their time; the sums of buckets and ranges are added up first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage
from .words import word_count

_KEY = ["no_source", "source"]


def source_targets(totals: DataFrame, weights: Sequence[int], repeats: int, budget: int | None = None) -> DataFrame:
    """Adds weight and target to (no_source, source, source_size).

    Sources weigh ``weights``, repeating, by code point, null last. They share
    the budget (by default all words) by weight; no target is above
    ``repeats`` times its source's size, and what it leaves goes to the
    others by weight until none is above.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    alone = W.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(alone.orderBy(*_KEY)))
    ranked = ranked.withColumn("weight", F.element_at(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats)
    total = F.sum("source_size").over(alone) if budget is None else F.lit(int(budget))
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    rest = alone.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    before = alone.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # The level that holds if all sources before this one are full and it and the later ones are not.
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    ranked = ranked.withColumn("place", F.row_number().over(alone.orderBy(*order))).withColumn("level", level)
    ranked = ranked.withColumn("open", F.col("weight") * F.col("level") < F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(alone)
    ranked = ranked.withColumn("first", first)
    full = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.level"))
    return ranked.select(*_KEY, "source_size", "weight", target.alias("target"))


def queue(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    budget: int | None = None,
) -> DataFrame:
    """One row a document: id, size, source_size, target, until (words of the
    source up to and with it, in the shuffled order) and taken (how often).

    Sizes are words. A null text has none; a null source is a source of its
    own and ranks last. Documents shuffle by the MD5 of their id, so reruns
    agree; rows that repeat an id stay next to each other and count one by
    one. A source without words has the target 0. An empty table gives no
    rows. Columns besides the three named are ignored.
    """
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col), F.lit("")).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
        ),
        "sized",
    ).withColumn("bucket", F.substring("key", 1, 3))
    sums = sized.groupBy(*_KEY, "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy(*_KEY).agg(F.sum("words").alias("source_size")), weights, repeats, budget)
    prior = W.partitionBy(*_KEY).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*_KEY, "bucket", F.coalesce(F.sum("words").over(prior), F.lit(0)).alias("before"))
    within = W.partitionBy(*_KEY, "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = stage(
        sized.join(starts.join(targets, _KEY), [*_KEY, "bucket"]).select(
            "id", *_KEY, "size", "source_size", "target", "key",
            (F.col("before") + F.sum("size").over(within)).alias("until"),
        ),
        "queued",
    )
    cut = _cut(queued, repeats, budget)
    turns = sum((F.when(t <= F.col("last"), 1).otherwise(0) for t in _turns(repeats)), F.lit(0))
    # A source that gives nothing has no last copy; a document without words stays as it is.
    taken = F.when(F.col("size") > 0, F.when(F.col("last").isNotNull(), turns).otherwise(0)).otherwise(1)
    return queued.join(cut, _KEY, "left").select(
        F.col("id").alias(id_col), *_KEY, "size", "source_size", "target", "until", taken.cast("long").alias("taken")
    )


def _finish(turn: int) -> Column:
    """Virtual time at which a document's copy number ``turn`` finishes."""
    spent = F.lit(turn) * F.col("source_size") + F.col("until")
    return F.when(F.col("target") > 0, spent.cast("double") / F.col("target")).otherwise(F.lit(0.0))


def _turns(repeats: int) -> list[Column]:
    """The place of each of a document's copies in the order of all copies."""
    tie = [F.col(c) for c in (*_KEY, "until", "key")]
    return [F.struct(_finish(t).alias("finish"), *tie, F.lit(t).alias("turn")) for t in range(repeats)]


def _cut(queued: DataFrame, repeats: int, budget: int | None) -> DataFrame:
    """(no_source, source, last): the place of the last copy that each source
    gives to the mix, null if it gives none.

    All copies are sorted into ranges of their place. A copy is before the
    cut if the running sum up to it keeps to the budget: the sum of the
    ranges before its own, and that within its range. Of a source's copies
    those before the cut come first; the next one is taken too if the source
    is nearer to its target with it.
    """
    if budget is None:
        budget = queued.agg(F.sum("size")).first()[0] or 0
    copies = queued.where("size > 0").select(F.explode(F.array(*_turns(repeats))).alias("at"), "size", "target")
    ranged = stage(copies.repartitionByRange("at").withColumn("range", F.spark_partition_id()), "copies")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("words"))  # a row for each range
    before = F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("size").over(W.partitionBy("range").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    placed = ranged.withColumn("within", within).join(sums, "range")
    inside = F.col("before") + F.col("within") <= budget
    ends = placed.groupBy(F.col("at.no_source").alias("no_source"), F.col("at.source").alias("source")).agg(
        F.max(F.when(inside, F.col("at"))).alias("last"),
        F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("words"),
        F.min(F.when(~inside, F.struct("at", "size"))).alias("next"),
        F.first("target").alias("goal"),
    )
    nearer = F.abs(F.col("words") + F.col("next.size") - F.col("goal")) < F.abs(F.col("words") - F.col("goal"))
    return ends.select(*_KEY, F.when(nearer, F.col("next.at")).otherwise(F.col("last")).alias("last"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Rows that repeat an id are each emitted as often as the id is taken at
    most. A document without words adds nothing to any target and stays once.
    """
    taken = queue(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    times = taken.groupBy(F.col(id_col).alias("__id")).agg(F.max("taken").alias("__times"))
    joined = docs.join(times, docs[id_col].eqNullSafe(times["__id"])).where("__times > 0")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
