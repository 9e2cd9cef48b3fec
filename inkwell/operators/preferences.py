"""Preference queries: parsing, overlaps, leaks and labels."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import decide, text
from ..functions.vocab import NEGATIONS, PROTAGONIST, SURFACE_FORMS, SYNTHESIS_NEGATIONS

SEPARATORS = r"(?U)[\s,，;；/、|]+"


def parse(query: Column, negations: Sequence[str] = NEGATIONS, compound: str = PROTAGONIST) -> Column:
    """Struct of positive and negative terms, each in order without repeats.

    A token that begins with a negation is negative without it; a bare
    negation makes the next plain token negative. A positive token that ends
    in ``compound`` counts as two.
    """
    tokens = F.filter(F.split(text.strip(query), SEPARATORS), lambda t: t != "")

    def rest(token: Column) -> Column:
        """The token without its negation, "" for a bare one, null for none."""
        out = F.when(token == negations[0], F.lit("")).when(token.startswith(negations[0]), text.strip(F.substring(token, F.lit(len(negations[0]) + 1), F.length(token))))
        for m in negations[1:]:
            out = out.when(token == m, F.lit("")).when(token.startswith(m), text.strip(F.substring(token, F.lit(len(m) + 1), F.length(token))))
        return out

    parts = F.transform(tokens, lambda t: F.struct(t.alias("t"), rest(t).alias("r")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("positive"), none.alias("negative"), F.lit(False).alias("pending"))

    def step(s: Column, x: Column) -> Column:
        bare = x["r"] == ""
        plain = x["r"].isNull()
        negative = F.when(plain & s["pending"], F.array(x["t"])).when(~plain & ~bare, F.array(x["r"])).otherwise(none)
        split = F.array(F.substring(x["t"], F.lit(1), F.length(x["t"]) - len(compound)), F.lit(compound))
        whole = F.when(x["t"].endswith(compound) & (F.length(x["t"]) > len(compound)), split).otherwise(F.array(x["t"]))
        positive = F.when(plain & ~s["pending"], whole).otherwise(none)
        pending = F.when(plain, F.lit(False)).otherwise(bare)
        return F.struct(F.concat(s["positive"], positive).alias("positive"), F.concat(s["negative"], negative).alias("negative"), F.coalesce(pending, F.lit(False)).alias("pending"))

    return F.aggregate(
        parts, start, step, lambda s: F.struct(F.array_distinct(s["positive"]).alias("positive"), F.array_distinct(s["negative"]).alias("negative"))
    )


def self_contradictory(query: Column, wanted: Column, unwanted: Column, negations: Sequence[str] = SYNTHESIS_NEGATIONS) -> Column:
    """Whether an excluded term is also wanted, or named besides its exclusion."""
    marks = "(?:" + "|".join(negations) + r")\s*"

    def named(term: Column) -> Column:
        quoted = F.concat(F.lit("(?U)" + marks), F.lit(r"\Q"), term, F.lit(r"\E"))
        return F.array_contains(wanted, term) | F.regexp_replace(query, quoted, F.lit("")).contains(term)

    return F.exists(unwanted, named)


def positive_tokens(query: Column, unwanted: Column) -> Column:
    """The query's tokens that hold no excluded term."""
    return F.filter(text.query_tokens(query), lambda t: ~F.exists(unwanted, lambda u: t.contains(u)))


def overlapping(rows: DataFrame, reserved: DataFrame, tokens: str, *, key: str, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """Ids of rows whose tokens overlap those of a reserved row enough.

    ``reserved`` has ``ref`` and the same tokens column. Sets of fewer than
    ``least`` tokens match nothing.

    Ids and single tokens travel, never a whole set beside each of its
    tokens. Below a threshold of a half a pair may meet on most tokens, so the
    tokens that pairs share are counted. From there on pairs meet on few: of
    the smaller set of a pair, ``threshold`` of the tokens are shared, so one
    of its others-plus-one rarest tokens is. Only those are looked up in the
    other side, and the sets are compared where they meet.
    """
    a, b = _numbered(rows, key, tokens, ("k", "i", "a", "n"), least), _numbered(reserved, "ref", tokens, ("r", "j", "b", "m"), least)
    every_a, every_b = (side.select(*ids, F.explode(F.array_distinct(words)).alias("token")) for side, ids, words in ((a, _A, "a"), (b, _B, "b")))
    if threshold < 0.5:
        shared = every_a.join(every_b, "token").groupBy(*_A, *_B).count()
        close = shared.where(F.col("count") / F.least("n", "m") >= threshold)
    else:

        def rarest(side: DataFrame, ids: tuple[str, ...], other: DataFrame) -> DataFrame:
            """The side's ids with its rarest tokens in the other, as ``token``."""
            held = other.groupBy("token").count()
            # A token that the other side lacks meets nothing, but takes a place among the rarest.
            by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("f"), "token")))
            ranked = side.join(held, "token", "left").groupBy(*ids).agg(by_rarity.alias("by"))
            size = F.col(ids[-1])
            enough = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
            return ranked.select(*ids, F.explode(F.slice("by", 1, enough)).alias("at")).where("at.f > 0").select(*ids, "at.token")

        small_a = rarest(every_a, _A, every_b).join(every_b, "token").where("n <= m")
        small_b = rarest(every_b, _B, every_a).join(every_a, "token").where("m < n")
        pairs = small_a.select(*_A, *_B).unionByName(small_b.select(*_A, *_B)).distinct()
        one, two = F.struct("k", "i").alias("x"), F.struct("r", "j").alias("y")
        met = pairs.select("k", "n", "m", one, two).join(a.select(one, "a"), "x").join(b.select(two, "b"), "y")
        close = met.where(F.size(F.array_intersect("a", "b")) / F.least("n", "m") >= threshold)
    return close.select(F.col("k").alias(key)).distinct()


_A, _B = ("k", "i", "n"), ("r", "j", "m")


def _numbered(side: DataFrame, key: str, tokens: str, names: tuple[str, str, str, str], least: int) -> DataFrame:
    """Key, number, tokens and size of each set under these names; the number
    tells sets of one key apart."""
    k, i, words, size = names
    sets = side.select(F.col(key).alias(k), F.col(tokens).alias(words), F.size(tokens).alias(size)).where(F.col(size) >= max(least, 1))
    return sets.withColumn(i, F.row_number().over(W.partitionBy(k).orderBy(words)))


def leaking(queries: DataFrame, reserved: DataFrame, *, key: str = "query_id", threshold: float = 0.8) -> DataFrame:
    """Ids of queries whose positive half repeats that of a reserved query
    (query, unwanted, ref); halves of one token prove nothing."""
    mine = queries.select(key, positive_tokens(F.col("query"), F.col("unwanted")).alias("tokens"))
    theirs = reserved.select("ref", positive_tokens(F.col("query"), F.col("unwanted")).alias("tokens"))
    return overlapping(mine, theirs, "tokens", key=key, threshold=threshold, least=2)


def deduplicate(queries: DataFrame, reserved: DataFrame, *, key: str = "query_id", order: str = "seq", threshold: float = 0.8, group: str | None = None) -> DataFrame:
    """Adds outcome: kept, duplicate or leak.

    A query is a duplicate if it overlaps a reserved query or an earlier one
    that was kept. Which are kept depends on the order, so what is left after
    the checks against reserved queries goes through one pass in order, by
    ``group`` if given; the pass holds the kept queries' tokens alone.
    """
    toks = queries.withColumn("__t", text.query_tokens(F.col("query")))
    repeats = overlapping(toks.select(key, "__t"), reserved.select("ref", text.query_tokens(F.col("query")).alias("__t")), "__t", key=key, threshold=threshold)
    leaks = leaking(queries, reserved, key=key, threshold=threshold).withColumn("__leak", F.lit(True))
    marked = toks.join(repeats.withColumn("__dup", F.lit(True)), key, "left").join(leaks, key, "left")
    schema = StructType([*queries.schema.fields]).add("outcome", "string")

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        kept: dict[int, int] = {}
        by_token: dict[str, list[int]] = {}
        outcome = []
        for i, (tokens, dup, leak) in enumerate(zip(frame["__t"], frame["__dup"], frame["__leak"])):
            mine = set(tokens)
            shared: dict[int, int] = {}
            for t in mine:
                for j in by_token.get(t, ()):
                    shared[j] = shared.get(j, 0) + 1
            if dup is True or any(c / min(len(mine), kept[j]) >= threshold for j, c in shared.items()):
                outcome.append("duplicate")
            elif leak is True:
                outcome.append("leak")
            else:
                outcome.append("kept")
                kept[i] = len(mine)
                for t in mine:
                    by_token.setdefault(t, []).append(i)
        return frame.assign(outcome=outcome)[list(schema.names)]

    marked = marked.withColumn("__group", F.col(group) if group else F.lit(0))
    return marked.groupBy("__group").applyInPandas(greedy, schema)


def violated_terms(claimed: Column, unwanted: Column) -> Column:
    """The excluded terms that the claims mention, in the query's order."""
    return F.filter(unwanted, lambda t: (t != "") & F.exists(claimed, lambda c: c.contains(t)))


def mentions_any(value: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: (t != "") & value.contains(t))


def aligned(flags: Column, reason: Column, matched: Column, terms: Column, violates: Column) -> Column:
    """Verdict fields rebuilt from the rule: violated terms, flags that do not
    speak of them, and a reason that says what the rule found."""
    listed = F.array_join(terms, "、")
    head = F.when(F.size(matched) > 0, F.concat(F.lit("符合"), F.array_join(F.slice(matched, 1, 3), "、"), F.lit("；"))).otherwise("")
    found = F.when(violates, F.concat(F.lit("但「"), listed, F.lit("」在正文中多次出现，不符合排除要求。"))).otherwise(F.concat(F.lit("「"), listed, F.lit("」在正文中几乎没有出现，符合排除要求。")))
    return F.struct(
        F.when(violates, terms).otherwise(F.array().cast("array<string>")).alias("violated"),
        F.filter(flags, lambda f: ~mentions_any(f, terms)).alias("flags"),
        F.when(mentions_any(reason, terms) | violates, F.concat(head, found)).otherwise(reason).alias("reason"),
    )


def relabel(queries: DataFrame, verdict: str = "rule_verdict") -> DataFrame:
    """Seeds labelled by the rule: queries that it cannot check pass, those on
    which it abstains are dropped."""
    checked = F.col("constraint_checkable") & (F.size("unwanted") > 0)
    kept = queries.where(~checked | F.col(verdict).isNotNull())
    return kept.withColumn("seed_satisfies_constraint", F.when(checked, ~F.col(verdict)).otherwise(F.col("seed_satisfies_constraint")))


def claim_agrees(verdict: Column, satisfies: Column) -> Column:
    """Whether a claim about a seed agrees with the rule; null if it abstains."""
    return F.when(verdict.isNotNull(), satisfies != verdict)


def stratified_term(number: Column, vocabulary: Sequence[str] = tuple(SURFACE_FORMS)) -> Column:
    """Terms in code point order, over and over; ``number`` counts from 0."""
    words = sorted(set(vocabulary))
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def refresh_checkable(queries: DataFrame) -> DataFrame:
    return queries.withColumn("constraint_checkable", decide.checkable(F.coalesce("unwanted", F.array().cast("array<string>"))))


def merge_frozen(frozen: DataFrame, drafts: DataFrame) -> DataFrame:
    """Frozen queries and the drafts with new ids, flags derived anew."""
    new = drafts.join(frozen.select("query_id").distinct(), "query_id", "left_anti")
    return refresh_checkable(frozen.unionByName(new, allowMissingColumns=True)).orderBy("query_id")


