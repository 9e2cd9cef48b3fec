"""Metrics, agreement and divergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decide, text
from ..schemas import require_columns


def manual_metrics(rows: DataFrame, k: int = 10, *, keep: Column | None = None) -> DataFrame:
    """By system: judged rows within ``k``, shares of labels, mean label and
    violation rate, averaged over rows. ``keep`` restricts the rows, say to
    queries with an exclusion."""
    require_columns(rows, "system_variant", "rank", "relevance_label", "constraint_violation")
    rows = rows.where((F.col("rank") <= k) & (F.lit(True) if keep is None else keep))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("system_variant").agg(
        F.count(F.lit(1)).alias("judged_rows"),
        share(F.col("relevance_label") >= 1).alias("precision"),
        share(F.col("relevance_label") == 2).alias("strong_precision"),
        F.avg(F.col("relevance_label").cast("double")).alias("mean_relevance"),
        share(F.col("constraint_violation")).alias("violation_rate"),
    )


def anchor_metrics(results: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 5, 10), folds: DataFrame | None = None) -> DataFrame:
    """By system and k: hit rate, anchor recall, and at the largest k the mean
    first rank; with ``folds`` (anchor, fold) recall by fold instead.

    The first k rows of a query are those of the least ranks. A query counts
    as hit if it has any of its anchors; all queries with anchors count for
    every system, and one that returned nothing is a miss. Without any
    anchors the rates are 0.
    """
    place = F.row_number().over(W.partitionBy("query_id", "system_variant").orderBy("rank", "title_guess"))
    ranked = results.withColumn("place", place).where(F.col("place") <= max(ks))
    anchors = queries.select("query_id", F.explode("anchor_titles").alias("anchor"))
    if folds is not None:
        anchors = anchors.join(folds.select("anchor", "fold").dropDuplicates(["anchor"]), "anchor", "left").fillna("unknown", ["fold"])
    systems = results.select("system_variant").where("system_variant <> ''").distinct()
    # Titles meet the anchors of their own query only.
    hits = ranked.join(anchors, "query_id").where(text.title_names(F.col("title_guess"), F.col("anchor")))
    per = hits.groupBy("system_variant", "query_id", "anchor").agg(F.min("place").alias("place"), F.min_by("rank", "place").alias("rank"))
    every = anchors.join(F.broadcast(systems)).join(per, ["system_variant", "query_id", "anchor"], "left")
    at = every.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    found = F.coalesce(F.col("place") <= F.col("k"), F.lit(False))
    if folds is not None:
        return at.groupBy("system_variant", "k", "fold").agg(
            F.count_if(found).alias("found"), F.count(F.lit(1)).alias("total"), F.avg(found.cast("double")).alias("recall")
        )
    one = at.groupBy("system_variant", "k", "query_id").agg(
        F.count_if(found).alias("found"), F.count(F.lit(1)).alias("anchors"), F.min_by(F.when(found, F.col("rank")), F.col("place")).alias("first_rank")
    )
    top = (F.col("k") == max(ks)) & (F.col("found") > 0)
    rates = one.groupBy("system_variant", "k").agg(
        F.avg((F.col("found") > 0).cast("double")).alias("hit_rate"),
        (F.sum("found") / F.sum("anchors")).alias("anchor_recall"),
        F.avg(F.when(top, F.col("first_rank"))).alias("mean_first_rank"),
    )
    named = systems.select("system_variant", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return named.join(rates, ["system_variant", "k"], "left").fillna(0.0, ["hit_rate", "anchor_recall"])


def anchor_folds(queries: DataFrame, titles: DataFrame, folds: DataFrame, *, order: str = "seq", key: str = "novel_id") -> DataFrame:
    """The fold of the first title that each anchor names, by corpus order; an
    anchor whose first title has no fold is left out.

    Prefixes are no equality, so titles are looked up under their prefixes of
    the anchors' lengths, of which there are few.
    """
    anchors = queries.select(F.explode("anchor_titles").alias("anchor")).distinct()
    anchors = anchors.withColumn("__a", text.normalize_title(F.col("anchor"))).where("__a <> ''")
    sizes = anchors.agg(F.collect_set(F.length("__a")).alias("__sizes"))
    cut = titles.select(key, order, text.normalize_title(F.col("title_guess")).alias("__t")).join(F.broadcast(sizes))
    cut = cut.select(key, order, F.explode(F.filter("__sizes", lambda n: n <= F.length("__t"))).alias("n"), "__t")
    cut = cut.select(key, order, F.substring("__t", F.lit(1), F.col("n")).alias("__a"))
    first = cut.join(anchors, "__a").groupBy("anchor").agg(F.min_by(key, F.struct(order, key)).alias(key))
    return first.join(folds.select(key, "fold"), key).select("anchor", "fold")


def confusion(pairs: DataFrame, a: str, b: str, levels: Sequence[int]) -> DataFrame:
    """Counts of label pairs; an unknown label is an error."""
    known = [F.lit(x) for x in levels]
    good = F.col(a).isin(*known) & F.col(b).isin(*known)
    checked = pairs.withColumn(a, F.when(good, F.col(a)).otherwise(F.raise_error(F.lit("unknown label")).cast("int")))
    return checked.groupBy(F.col(a).alias("rater_a"), F.col(b).alias("rater_b")).agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, a: str, b: str, levels: Sequence[int] | None = None, weighted: bool = False) -> DataFrame:
    """One row: n, kappa and its band. Weights are linear in the levels'
    positions. A single level gives 1 or 0; no rows give a null."""
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = pairs.groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # A few cells from here on, whatever the number of pairs.
    if levels is None:
        given = cells.select(F.explode(F.array("a", "b")).alias("level")).agg(F.array_sort(F.collect_set("level")).alias("levels"))
    else:
        given = cells.sparkSession.range(1).select(F.array(*[F.lit(float(x)) for x in sorted(set(levels))]).alias("levels"))
    packed = cells.agg(F.coalesce(F.collect_list(F.struct("a", "b", "n")), F.array()).alias("cells")).join(given)
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + x["n"]).cast("double")
    span = F.greatest(F.size("levels") - 1, F.lit(1))

    def weight(x: Column, y: Column) -> Column:
        if not weighted:
            return F.when(x == y, 0.0).otherwise(1.0)
        return F.abs(F.array_position("levels", x) - F.array_position("levels", y)) / span

    def marginal(field: str, level: Column) -> Column:
        return F.aggregate(F.filter("cells", lambda c: c[field] == level), F.lit(0).cast("long"), lambda s, c: s + c["n"]) / total

    seen = F.aggregate("cells", F.lit(0.0), lambda s, c: s + weight(c["a"], c["b"]) * c["n"] / total)
    chance = F.aggregate(
        F.transform("levels", lambda x: F.aggregate(F.transform("levels", lambda y: weight(x, y) * marginal("a", x) * marginal("b", y)), F.lit(0.0), lambda s, v: s + v)),
        F.lit(0.0), lambda s, v: s + v,
    )
    out = packed.select(total.cast("long").alias("n"), F.size("levels").alias("k"), seen.alias("seen"), chance.alias("chance"))
    value = F.when(F.col("n") == 0, None).when((F.col("k") < 2) | (F.col("chance") == 0), F.when(F.col("seen") == 0, 1.0).otherwise(0.0))
    out = out.select("n", value.otherwise(1 - F.col("seen") / F.col("chance")).alias("kappa"))
    return out.withColumn("band", decide.kappa_band(F.col("kappa")))


def agreement(rows: DataFrame) -> DataFrame:
    """Of rows with all four labels: weighted kappa of relevance, kappa of
    violations, exact agreement; rounded to four places."""
    names = ("relevance_label", "judge_relevance_label", "constraint_violation", "judge_constraint_violation")
    require_columns(rows, *names)
    rows = rows.dropna(subset=list(names))
    exact = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(names[0]) == F.col(names[1])).cast("double")).alias("exact"),
        F.avg((F.col(names[2]) == F.col(names[3])).cast("double")).alias("violation_agreement"),
    )
    flags = rows.select(F.col(names[2]).cast("int").alias("a"), F.col(names[3]).cast("int").alias("b"))
    one = kappa(rows, names[0], names[1], (0, 1, 2), weighted=True).select(F.round("kappa", 4).alias("relevance_kappa"), F.col("band").alias("relevance_band"))
    two = kappa(flags, "a", "b", (0, 1)).select(F.round("kappa", 4).alias("violation_kappa"), F.col("band").alias("violation_band"))
    return exact.select("n", F.round("exact", 4).alias("exact_agreement"), F.round("violation_agreement", 4).alias("violation_agreement")).join(one).join(two)


def human_and_judge(sheet: DataFrame, judged: DataFrame) -> DataFrame:
    """Sheet rows that were judged; of several verdicts of a pair the first by
    ``seq`` counts."""
    first = judged.groupBy("query_id", "novel_id").agg(
        F.min_by(F.struct("judge_relevance_label", "judge_constraint_violation"), "seq").alias("j")
    )
    return sheet.join(first, ["query_id", "novel_id"]).select(*[sheet[c] for c in sheet.columns], "j.*")


def disagreements(rows: DataFrame, gap: int = 2) -> DataFrame:
    return rows.where(F.abs(F.col("relevance_label") - F.col("judge_relevance_label")) >= gap).withColumn("gap", F.abs(F.col("relevance_label") - F.col("judge_relevance_label")))


def _cells(rule: Column, judge: Column) -> list[Column]:
    names = (("true_positive", rule & judge), ("false_positive", rule & ~judge), ("false_negative", ~rule & judge), ("true_negative", ~rule & ~judge))
    return [F.count_if(c).alias(n) for n, c in names]


def divergence(rows: DataFrame) -> DataFrame:
    """Rule against judge: counts, abstentions, agreement, and the share of
    judged violations that the rule misses."""
    rule, judge = F.col("rule"), F.col("judge")
    out = rows.agg(F.count(F.lit(1)).alias("pairs"), F.count("rule").alias("decided"), *_cells(rule, judge))
    judged = F.col("true_positive") + F.col("false_negative")
    right = F.col("true_positive") + F.col("true_negative")
    return out.withColumns(
        {
            "abstained": F.col("pairs") - F.col("decided"),
            "agreement": F.when(F.col("decided") > 0, right / F.col("decided")).otherwise(0.0),
            "rule_miss_rate": F.when(judged > 0, F.col("false_negative") / judged).otherwise(0.0),
        }
    )


def divergence_by_term(rows: DataFrame) -> DataFrame:
    """The same by term, over decided pairs."""
    rule, judge = F.col("rule"), F.col("judge")
    return rows.where(rule.isNotNull()).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.avg((rule == judge).cast("double")).alias("agreement"),
        F.count_if(~rule & judge).alias("misses"), F.count_if(rule & ~judge).alias("over_fires"),
    )


def result_rows(ranked: DataFrame) -> DataFrame:
    """Flat rows for a results file: lists are joined."""
    joins = {"violated": ",", "flags": "|", "sources": ",", "reasons": "|"}
    return ranked.select(*[F.array_join(c, joins[c]).alias(c) if c in joins else F.col(c) for c in ranked.columns])
