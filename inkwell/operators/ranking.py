"""Choosing candidates to score, scoring them through a cache, and fusion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decide
from ..functions.answers import parse_match
from ..functions.vocab import PROFILE_MARKS
from ..protocols import Completer, complete

REASONS = ("retrieval_score_top", "semantic_score_top", "best_faiss_rank_top")


def _all(group: Sequence[str]):
    return W.partitionBy(*group) if group else W.partitionBy(F.lit(1))


def select_for_scoring(
    candidates: DataFrame, k: int, *, group: Sequence[str] = (), key: str = "novel_id", forced: Column | None = None
) -> DataFrame:
    """The ``k`` candidates worth scoring, with the reasons for each.

    Half come from the best retrieval scores, then semantic scores, then
    ranks; places that the views share are filled by retrieval score. Ties go
    by ``seq``, the candidates' order. If ``forced`` holds for one that was
    not chosen, the first such takes the last place.
    """
    first = F.row_number().over(W.partitionBy(*group, key).orderBy("seq"))
    rows = candidates.withColumn("__first", first).where("__first = 1").drop("__first")
    every = _all(group)
    rows = rows.withColumns(
        {
            "__r": F.row_number().over(every.orderBy(F.desc("retrieval_score"), "seq")),
            "__s": F.row_number().over(every.orderBy(F.desc("best_score"), "seq")),
            "__b": F.row_number().over(every.orderBy(F.coalesce("best_rank", F.lit(1_000_000)), "seq")),
            "__n": F.count(F.lit(1)).over(every),
        }
    )
    # A pool smaller than k has quotas of its own size.
    table = F.array(*[F.array(*[F.lit(q) for q in decide.selection_quotas(n)]) for n in range(1, k + 1)])
    quota = F.get(table, F.least(F.col("__n"), F.lit(k)).cast("int") - 1)
    hits = [F.col(c) <= F.get(quota, F.lit(i)) for i, c in enumerate(("__r", "__s", "__b"))]
    reasons = F.filter(F.array(*[F.when(h, F.lit(r)) for h, r in zip(hits, REASONS)]), lambda x: x.isNotNull())
    several = F.when(F.size(reasons) > 1, F.concat(reasons, F.array(F.lit("already_selected_multiple_reasons")))).otherwise(reasons)
    rows = rows.withColumn("reasons", several).withColumn("__hit", F.size("reasons") > 0)
    # Places in the order in which the views name candidates, then by retrieval score.
    named = [F.struct(F.lit(i).alias("view"), F.col(c).alias("n")) for i, c in enumerate(("__r", "__s", "__b", "__r"))]
    view = F.when(hits[0], named[0]).when(hits[1], named[1]).when(hits[2], named[2]).otherwise(named[3])
    rows = rows.withColumn("place", F.row_number().over(every.orderBy(view)))
    rows = rows.withColumn("reasons", F.when(F.col("__hit"), F.col("reasons")).otherwise(F.array(F.lit(REASONS[0]))))
    if forced is None:
        out = rows.where(F.col("place") <= k)
    else:
        want = F.coalesce(forced, F.lit(False))
        rows = rows.withColumn("__target", want & (F.row_number().over(every.orderBy(F.when(want, 0).otherwise(1), "seq")) == 1))
        rows = rows.withColumn("__outside", F.coalesce(F.bool_or(F.col("__target") & (F.col("place") > k)).over(every), F.lit(False)))
        swap = F.col("__outside") & F.col("__target")
        rows = rows.withColumn("reasons", F.when(swap, F.array(F.lit("debug_target_forced"))).otherwise(F.col("reasons")))
        rows = rows.where(F.when(F.col("__outside"), F.col("__target") | (F.col("place") < k)).otherwise(F.col("place") <= k))
        out = rows.withColumn("place", F.when(swap, F.lit(k)).otherwise(F.col("place"))).drop("__target", "__outside")
    return out.drop("__r", "__s", "__b", "__n", "__hit").withColumn("reason", F.get("reasons", F.lit(0)))


def normalized(score: Column, group: Sequence[str] = ()) -> Column:
    """Min-max within the pool; 1 for a pool of one value."""
    low, high = F.min(score).over(_all(group)), F.max(score).over(_all(group))
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def fuse(
    candidates: DataFrame, *, group: Sequence[str] = (), policy: str = "impute", scaled_risk: bool = False, text: Column | None = None, marks: Sequence[str] = PROFILE_MARKS
) -> DataFrame:
    """Final scores and ranks of scored and unscored candidates alike.

    ``candidates`` has best_score, matched, and match_score, confidence,
    violated and flags, null where nothing was scored. Under ``impute`` an
    unscored one counts as the average of the scored, under ``legacy`` it has
    a formula of its own. Ranks go by scores of nine places, so that equal
    scores tie however their sums were rounded; ties go by retrieval_rank.
    """
    if policy not in ("impute", "legacy"):
        raise ValueError("policy is impute or legacy")
    every = _all(group)
    scored = F.col("match_score").isNotNull()
    sure = F.when(scored, decide.confidence_score(decide.confidence_level(F.col("confidence"))))
    risk = decide.risk_penalty(F.coalesce("violated", F.array().cast("array<string>")), F.col("confidence"), F.coalesce("flags", F.array().cast("array<string>")), F.lit("") if text is None else text, scaled=scaled_risk, marks=marks)
    rows = candidates.withColumns({"semantic": normalized(F.col("best_score"), group), "confidence_score": sure, "risk_penalty": F.when(scored, risk).otherwise(0.0)})
    rows = rows.withColumns(
        {
            "imputed_match": F.coalesce(F.avg("match_score").over(every), F.lit(decide.PRIOR_MATCH)),
            "imputed_confidence": F.coalesce(F.avg("confidence_score").over(every), F.lit(decide.PRIOR_CONFIDENCE)),
        }
    )
    guess = decide.fused(F.col("semantic"), F.col("imputed_match"), F.col("imputed_confidence")) if policy == "impute" else decide.legacy_score(F.col("semantic"), F.col("matched"))
    final = F.when(scored, decide.fused(F.col("semantic"), F.col("match_score"), F.col("confidence_score"), F.col("risk_penalty"))).otherwise(guess)
    rows = rows.withColumn("final_score", final)
    for name in ("imputed_match", "imputed_confidence"):
        rows = rows.withColumn(name, F.when(~scored & F.lit(policy == "impute"), F.col(name)))
    return rows.withColumn("final_rank", F.row_number().over(every.orderBy(F.round("final_score", 9).desc(), "retrieval_rank")))


def contributions(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """How much each component moves the score: weight times spread, and its
    share of all; shares are null if nothing moves it."""
    spread = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    out = rows.groupBy(*group).agg(
        (decide.WEIGHTS["semantic"] * spread("semantic")).alias("semantic"),
        (decide.WEIGHTS["match"] * spread("match_score")).alias("llm_match"),
        (decide.WEIGHTS["confidence"] * spread("confidence_score")).alias("confidence"),
        spread("risk_penalty").alias("risk_penalty"),
    )
    names = ("semantic", "llm_match", "confidence", "risk_penalty")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    out = out.withColumn("total_spread", F.greatest(total, F.lit(0.0)))
    return out.withColumns({f"{n}_share": F.when(F.col("total_spread") > 0, F.col(n) / F.col("total_spread")) for n in names})


def with_profiles(candidates: DataFrame, profiles: DataFrame, key: str = "novel_id") -> DataFrame:
    """Adds profile_text, the preview where a profile is missing or empty."""
    known = profiles.select(key, F.col("profile_text").alias("__p")).dropDuplicates([key])
    text = F.coalesce(F.nullif("__p", F.lit("")), F.col("profile_text_preview"))
    return candidates.join(known, key, "left").withColumn("profile_text", text).drop("__p")


def score(pending: DataFrame, cache: DataFrame, load: Callable[[], Completer], *, key_col: str = "cache_key", threads: int = 8) -> DataFrame:
    """Adds response and provider to prompts: cached answers are looked up, the
    others are asked for. A request that died has no answer and is told by
    ``rule_fallback``; ``new_answers`` leaves it out of the cache."""
    latest = cache.groupBy(key_col).agg(F.max_by("response", "seq").alias("__known"))
    joined = pending.join(latest, key_col, "left")
    hit = joined.where("__known IS NOT NULL").withColumns({"response": F.col("__known"), "provider": F.lit("cache")}).drop("__known")
    asked = complete(joined.where("__known IS NULL").drop("__known"), load, threads=threads)
    asked = asked.withColumn("provider", F.when(F.col("response").isNull(), "rule_fallback").otherwise("llm"))
    return hit.unionByName(asked)


def new_answers(scored: DataFrame, seq: Column, key_col: str = "cache_key") -> DataFrame:
    """Rows to append to the cache after ``score``."""
    return scored.where("provider = 'llm'").select(key_col, seq.alias("seq"), "response")


def with_matches(scored: DataFrame) -> DataFrame:
    """Match fields from the answers. A dead or unreadable answer counts as
    score 0 with low confidence; a candidate that was never asked stays null."""
    parsed = scored.withColumn("__m", parse_match(F.col("response")))
    asked = F.col("provider").isNotNull()
    empty = F.array().cast("array<string>")
    return parsed.withColumns(
        {
            "match_score": F.when(asked, F.coalesce("__m.score", F.lit(0.0))),
            "confidence": F.when(asked, F.coalesce("__m.confidence", F.lit("low"))),
            "matched_preferences": F.when(asked, F.coalesce("__m.matched", empty)),
            "violated": F.when(asked, F.coalesce("__m.violated", empty)),
            "flags": F.when(asked, F.coalesce("__m.flags", empty)),
            "reason_text": F.col("__m.reason"),
        }
    ).drop("__m")
