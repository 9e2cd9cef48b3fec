"""Candidate pools, evaluation runs and training sets for many requests at once.

Requests are rows (query_id, query), never a loop: their variants, hits,
verdicts and answers are tables keyed by query_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decide, prompts
from ..operators import datasets, preferences, ranking, retrieval
from ..protocols import Completer, Encoder, complete, embed


@dataclass(frozen=True)
class Corpus:
    """vectors (novel_id, row, embedding), profiles (novel_id, title_guess,
    profile_text), and if wanted folds (novel_id, fold) and densities."""

    vectors: DataFrame
    profiles: DataFrame
    folds: DataFrame | None = None
    densities: DataFrame | None = None


def pools(queries: DataFrame, corpus: Corpus, encoder: Callable[[], Encoder], *, per_query: int = 100, size: int = 100, variants: int = 5, fold: str | None = None) -> DataFrame:
    """The candidates of each request with pool_rank from 0, title and profile.

    ``queries`` may have ``answer``, a model's expansion. With ``fold`` twice
    as many candidates are merged, then those of other folds or of none are
    dropped, then the pool is cut to ``size``.
    """
    asked = retrieval.variants(queries, most=variants).withColumn("vid", F.xxhash64("query_id", "seq"))
    vectors = embed(asked.select(F.col("vid").alias("query_id"), "text"), encoder, text_col="text", role="query")
    hits = retrieval.search(vectors, corpus.vectors.select(F.col("row").alias("vec_id"), "embedding"), per_query)
    hits = hits.withColumnRenamed("query_id", "vid").join(corpus.vectors.select(F.col("row").alias("vec_id"), "novel_id"), "vec_id")
    totals = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hits = hits.join(asked.drop("text"), "vid").join(totals, "query_id")
    merged = retrieval.merge(hits, group=["query_id"], total=F.col("total"), k=size if fold is None else 2 * size)
    if fold is not None:
        merged = merged.join(corpus.folds.where(F.col("fold") == fold).select("novel_id").distinct(), "novel_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("retrieval_rank")) - 1
    known = corpus.profiles.groupBy("novel_id").agg(F.min(F.struct("title_guess", "profile_text")).alias("p")).select("novel_id", "p.*")
    return merged.withColumn("pool_rank", rank).where(F.col("pool_rank") < size).join(known, "novel_id", "left")


def _ruled(pool: DataFrame, queries: DataFrame, corpus: Corpus) -> DataFrame:
    """Adds the terms that the rule checks, its verdict, and the request."""
    terms = F.filter(F.transform(F.coalesce("unwanted", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: decide.known_term(t))
    asked = queries.select("query_id", "query", "unwanted", *[c for c in ("seed_novel_id", "arm") if c in queries.columns], terms.alias("constraint_terms"))
    measured = decide.density_map(corpus.densities)
    joined = pool.join(asked, "query_id").join(measured, "novel_id", "left")
    return joined.withColumn("rule_verdict", decide.verdict_of(F.col("constraint_terms"), F.col("densities"))).drop("densities")


def episodes(queries: DataFrame, corpus: Corpus, encoder: Callable[[], Encoder], *, seed: int, fold: str = "train", depth: int = 20, most: int = 4, chars: int = 1200, **sizes) -> DataFrame:
    """Balanced rollout episodes: requests without a checkable exclusion,
    candidates on which the rule abstains and those without a profile go."""
    rows = _ruled(pools(queries, corpus, encoder, fold=fold, **sizes), queries, corpus).where(F.size("constraint_terms") > 0)
    rows = rows.where(F.col("rule_verdict").isNotNull() & (F.coalesce("profile_text", F.lit("")) != ""))
    kept = datasets.balanced(rows, seed, depth=depth, most=most)
    return kept.withColumn("prompt", prompts.match(F.col("query"), F.col("title_guess"), F.substring("profile_text", 1, chars)))


def fine_tuning(queries: DataFrame, corpus: Corpus, encoder: Callable[[], Encoder], teacher: Callable[[], Completer], *, seed: int, cache: DataFrame, fold: str = "train", head: int = 10, tail: int = 10, chars: int = 1200, model: str = "", **sizes) -> DataFrame:
    """Prompts and targets: a teacher's answers, overruled by the rule where
    it decides. Candidates whose request died give no sample."""
    rows = datasets.head_and_tail(_ruled(pools(queries, corpus, encoder, fold=fold, **sizes), queries, corpus), head, tail, seed)
    text = F.substring(F.coalesce("profile_text", F.lit("")), 1, chars)
    rows = rows.withColumn("prompt", prompts.match(F.col("query"), F.col("title_guess"), text))
    rows = rows.withColumn("cache_key", decide.cache_key(prompt_hash=F.sha2("prompt", 256), model=F.lit(model)))
    told = ranking.with_matches(ranking.score(rows, cache, teacher)).where("response IS NOT NULL")
    fixed = preferences.aligned(F.col("flags"), F.coalesce("reason_text", F.lit("")), F.col("matched_preferences"), F.col("constraint_terms"), F.col("rule_verdict"))
    decided = F.col("rule_verdict").isNotNull()
    said = preferences.violated_terms(F.col("violated"), F.coalesce("unwanted", F.array().cast("array<string>")))
    target = F.to_json(
        F.struct(
            F.col("match_score").alias("llm_match_score"), "confidence", "matched_preferences",
            F.when(decided, fixed["violated"]).otherwise(said).alias("violated_preferences"),
            F.when(decided, fixed["flags"]).otherwise(F.col("flags")).alias("risk_flags"),
            F.when(decided, fixed["reason"]).otherwise(F.coalesce("reason_text", F.lit(""))).alias("reason"),
        )
    )
    source = F.when(decided, "rule").when(F.size("constraint_terms") > 0, "rule_abstained").otherwise("teacher")
    return told.select(
        "query_id", "query", *[c for c in ("arm", "seed_novel_id") if c in told.columns], "novel_id", "title_guess", "pool_rank",
        F.when(F.col("pool_rank") < head, "head").otherwise("tail").alias("selection"), "constraint_terms", "rule_verdict",
        source.alias("label_source"), "confidence", "prompt", target.alias("target"), F.lit(model).alias("teacher_model"),
    )


def evaluate(queries: DataFrame, corpus: Corpus, encoder: Callable[[], Encoder], matcher: Callable[[], Completer], *, cache: DataFrame, top_k: int = 10, scored: int = 10, policy: str = "impute", chars: int = 4000, model: str = "", **sizes) -> DataFrame:
    """Rows of two systems for all requests: the raw request's search, and
    expansion, selection, scoring and fusion."""
    plain = embed(queries.select(F.xxhash64("query_id").alias("query_id"), F.col("query").alias("text")), encoder, text_col="text", role="query")
    found = retrieval.search(plain, corpus.vectors.select(F.col("row").alias("vec_id"), "embedding"), top_k).withColumnRenamed("query_id", "vid")
    found = found.join(queries.select("query_id", F.xxhash64("query_id").alias("vid")), "vid").join(corpus.vectors.select(F.col("row").alias("vec_id"), "novel_id"), "vec_id")
    titles = corpus.profiles.groupBy("novel_id").agg(F.min("title_guess").alias("title_guess"))
    baseline = found.join(titles, "novel_id", "left").select("query_id", F.lit("baseline").alias("system_variant"), "rank", "novel_id", "title_guess", "score")
    pool = pools(queries, corpus, encoder, **sizes).withColumn("seq", F.col("retrieval_rank")).join(queries.select("query_id", "query"), "query_id")
    text = F.substring(F.coalesce("profile_text", F.lit("")), 1, chars)
    chosen = ranking.select_for_scoring(pool, scored, group=["query_id"])
    chosen = chosen.select("query_id", "novel_id", prompts.match(F.col("query"), F.col("title_guess"), text).alias("prompt"))
    chosen = chosen.withColumn("cache_key", decide.cache_key(prompt_hash=F.sha2("prompt", 256), model=F.lit(model)))
    told = ranking.with_matches(ranking.score(chosen, cache, matcher)).select("query_id", "novel_id", "match_score", "confidence", "violated", "flags", "provider")
    fused = ranking.fuse(pool.join(told, ["query_id", "novel_id"], "left"), group=["query_id"], policy=policy, text=F.coalesce("profile_text", F.lit("")))
    full = fused.where(F.col("final_rank") <= top_k).select("query_id", F.lit("full").alias("system_variant"), F.col("final_rank").alias("rank"), "novel_id", "title_guess", F.col("final_score").alias("score"))
    return baseline.unionByName(full)


def expansions(queries: DataFrame, cache: DataFrame, expander: Callable[[], Completer], *, model: str = "", most: int = 4) -> DataFrame:
    """``queries`` with ``answer``: cached expansions, and new ones for the
    rest. A request that died has none, and its raw query serves."""
    keyed = queries.withColumn("cache_key", decide.cache_key(query=F.col("query"), model=F.lit(model), most=F.lit(most)))
    asked = keyed.withColumn("prompt", prompts.expansion(F.col("query"), most))
    return ranking.score(asked, cache, expander).withColumnRenamed("response", "answer").drop("prompt")


def seeds(profiles: DataFrame, n: int, seed: int, *, chars: int = 1200, vocabulary=None) -> DataFrame:
    """Synthesis tasks: sampled books with the exclusion terms in turn."""
    chosen = datasets.sample(profiles, n, seed, "novel_id").withColumn("draw", decide.shuffled(seed, F.col("novel_id")))
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("draw", "novel_id")) - 1  # ``n`` rows
    term = preferences.stratified_term(number) if vocabulary is None else preferences.stratified_term(number, vocabulary)
    rows = chosen.withColumn("required", term).drop("draw")
    return rows.withColumn("prompt", prompts.synthesis(F.col("title_guess"), F.substring("profile_text", 1, chars), F.col("required"), F.lit(True)))


def synthesize(tasks: DataFrame, model: Callable[[], Completer]) -> DataFrame:
    """New requests from the answers to ``seeds``, those that contradict
    themselves left out."""
    from ..functions.answers import parse_synthesis

    told = complete(tasks, model).where("response IS NOT NULL").withColumn("q", F.explode(parse_synthesis(F.col("response"))))
    rows = told.select(F.col("novel_id").alias("seed_novel_id"), F.col("title_guess").alias("seed_title"), "q.query", "q.shape", "q.wanted", "q.unwanted", F.col("q.satisfies").alias("seed_satisfies_constraint"))
    kept = rows.where(~preferences.self_contradictory(F.col("query"), F.col("wanted"), F.col("unwanted")))
    return preferences.refresh_checkable(kept.withColumn("query_id", F.concat(F.lit("s"), F.substring(F.sha2("query", 256), 1, 12))))
