"""From a reader's request to a ranked, explained list."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decide, prompts
from ..operators import preferences, ranking, retrieval
from ..protocols import Completer, Encoder, complete, embed


@dataclass(frozen=True)
class Settings:
    """Sizes and switches of one discovery."""

    top_k: int = 10
    per_query: int = 100
    pool: int = 100
    scored: int | None = 20
    variants: int = 5
    policy: str = "impute"
    model: str = ""
    profile_chars: int = 4000


@dataclass
class Models:
    """Loaders of the models; only the encoder is needed."""

    encoder: Callable[[], Encoder]
    matcher: Callable[[], Completer] | None = None
    expander: Callable[[str], str | None] | None = None
    explainer: Callable[[], Completer] | None = None


def discover(spark: SparkSession, request: str, vectors: DataFrame, profiles: DataFrame, models: Models, settings: Settings = Settings(), cache: DataFrame | None = None) -> DataFrame:
    """The best ``top_k`` of the corpus for a request, with explanations.

    ``vectors`` has novel_id, a number ``row`` and embedding; ``profiles``
    novel_id, title_guess and profile_text. Without a matcher all candidates
    rank by their semantic score and the priors.
    """
    if not request.strip():
        raise ValueError("the request is empty")
    for table, names in ((vectors, ("novel_id", "row", "embedding")), (profiles, ("novel_id", "title_guess", "profile_text"))):
        if missing := [n for n in names if n not in table.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
    one = spark.range(1).select(F.lit(request).alias("q"))
    parsed = one.select(preferences.parse(F.col("q")).alias("p")).first()["p"]
    answer = models.expander(request) if models.expander else None
    variants = retrieval.expand(request, parsed["positive"], parsed["negative"], answer, settings.variants)
    queries = spark.createDataFrame([(i, q["text"], q["source"], q["weight"]) for i, q in enumerate(variants)], "seq int, text string, source string, weight double")
    asked = embed(queries.withColumnRenamed("seq", "query_id"), models.encoder, text_col="text", role="query")
    hits = retrieval.search(asked, vectors.select(F.col("row").alias("vec_id"), "embedding"), settings.per_query)
    hits = hits.join(vectors.select(F.col("row").alias("vec_id"), "novel_id"), "vec_id").join(F.broadcast(queries), F.col("query_id") == F.col("seq"))
    merged = retrieval.merge(hits, total=len(variants), k=settings.pool).withColumn("seq", F.col("retrieval_rank"))
    known = profiles.select("novel_id", "title_guess", "profile_text").dropDuplicates(["novel_id"])
    pool = merged.join(known, "novel_id", "left").withColumn("profile_text", F.coalesce("profile_text", F.lit("")))
    scored = _scored(pool, request, models, settings, cache)
    ranked = ranking.fuse(scored, policy=settings.policy, text=F.col("profile_text")).where(F.col("final_rank") <= settings.top_k)
    return explain(ranked, request, models.explainer)


def _scored(pool: DataFrame, request: str, models: Models, settings: Settings, cache: DataFrame | None) -> DataFrame:
    none = {"match_score": "double", "confidence": "string", "violated": "array<string>", "flags": "array<string>", "provider": "string"}
    k = decide.candidate_budget(settings.scored, settings.pool)
    if models.matcher is None or not k:
        return pool.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    text = F.substring("profile_text", 1, settings.profile_chars)
    chosen = ranking.select_for_scoring(pool, k).select("novel_id", prompts.match(F.lit(request), F.col("title_guess"), text).alias("prompt"))
    chosen = chosen.withColumn("cache_key", decide.cache_key(prompt_hash=F.sha2("prompt", 256), model=F.lit(settings.model)))
    if cache is None:
        cache = pool.sparkSession.createDataFrame([], "cache_key string, seq bigint, response string")
    answers = ranking.with_matches(ranking.score(chosen, cache, models.matcher))
    return pool.join(answers.select("novel_id", *none), "novel_id", "left")


def explain(ranked: DataFrame, request: str, load: Callable[[], Completer] | None) -> DataFrame:
    """Adds explanation: a model's summary, or one made of the scores. It
    never changes the order."""
    title = F.coalesce("title_guess", "novel_id")
    plain = F.concat(title, F.lit(": score "), F.format_number("final_score", 3), F.when(F.size("violated") > 0, F.concat(F.lit("; breaks "), F.array_join("violated", ", "))).otherwise(""))
    if load is None:
        return ranked.withColumn("explanation", plain).orderBy("final_rank")
    prompt = prompts.explanation(F.lit(request), title, F.col("profile_text"))
    told = complete(ranked.withColumn("prompt", prompt), load)
    found = F.get_json_object(F.regexp_extract("response", r"(?s)\{.*\}", 0), "$.summary")
    return told.withColumn("explanation", F.coalesce(F.nullif(found, F.lit("")), plain)).drop("prompt", "response").orderBy("final_rank")


def summary(spark: SparkSession, variants: list[dict]) -> dict[str, int]:
    """Query variants by source."""
    out: dict[str, int] = {}
    for q in variants:
        out[q["source"]] = out.get(q["source"], 0) + 1
    return out


def report(ranked: DataFrame, kind: str = "text") -> str:
    """The list as text, Markdown or JSON. It holds ``top_k`` rows."""
    rows = [r.asDict(recursive=True) for r in ranked.orderBy("final_rank").collect()]
    if kind == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    if kind not in ("text", "markdown"):
        raise ValueError("kind is text, markdown or json")
    mark = "**" if kind == "markdown" else ""
    return "\n".join(f"{r['final_rank']}. {mark}{r['title_guess'] or r['novel_id']}{mark} ({r['final_score']:.3f})\n   {r['explanation']}" for r in rows)
