"""What models are asked. The wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _listed(terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.array_join(terms, "、")).otherwise(F.lit("-"))


def match(query: Column, title: Column, profile: Column) -> Column:
    """How well a candidate fits a request."""
    fields = '{"llm_match_score": 0-1, "confidence": "high|medium|low", "matched_preferences": [], "violated_preferences": [], "risk_flags": [], "reason": ""}'
    return F.concat(
        F.lit("Rate how well this book fits the reader's request. Name each exclusion that it breaks.\nRequest: "), query,
        F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nProfile:\n"), profile, F.lit("\nAnswer with this JSON only: " + fields),
    )


def expansion(query: Column, most: int = 4) -> Column:
    """Other wordings of a request, to search by."""
    return F.concat(
        F.lit(f"Write up to {most} short search queries for books that fit this request. Keep its exclusions.\nRequest: "), query,
        F.lit('\nAnswer with this JSON only: {"expanded_queries": [{"text": "", "source": "llm", "weight": 0-1}]}'),
    )


def judge(query: Column, wanted: Column, unwanted: Column, title: Column, evidence: Column) -> Column:
    """A judge's label of one result, on evidence alone."""
    return F.concat(
        F.lit("Judge from the passages alone how relevant this book is: 2 fits, 1 fits in part, 0 does not.\nRequest: "), query,
        F.lit("\nWanted: "), _listed(wanted), F.lit("\nExcluded: "), _listed(unwanted), F.lit("\nTitle: "), F.coalesce(title, F.lit("")),
        F.lit("\nPassages:\n"), evidence,
        F.lit('\nAnswer with this JSON only: {"relevance_label": 0, "constraint_violation": false, "reason": "", "judge_confidence": "high|medium|low"}'),
    )


def synthesis(title: Column, profile: Column, required: Column, satisfies: Column, most: int = 3) -> Column:
    """Requests that a book answers; ``required`` is an exclusion that each
    must have, or null, and ``satisfies`` whether the book respects it."""
    claim = F.when(required.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("\nEach request excludes: "), required, F.when(satisfies, F.lit(" (the book respects this)")).otherwise(F.lit(" (the book breaks this)")))
    )
    return F.concat(
        F.lit(f"Write {most} requests that a reader might make and that lead to this book. Do not name it.\nTitle: "), F.coalesce(title, F.lit("")),
        F.lit("\nProfile:\n"), profile, claim,
        F.lit('\nAnswer with this JSON only: {"queries": [{"query": "", "shape": "kw|sent|like", "wanted": [], "unwanted": [], "seed_satisfies_constraint": true}]}'),
    )


def explanation(query: Column, title: Column, profile: Column) -> Column:
    return F.concat(
        F.lit("Explain in a sentence why this book fits the request.\nRequest: "), query, F.lit("\nBook: "), title, F.lit("\n"), profile,
        F.lit('\nAnswer with this JSON only: {"summary": ""}'),
    )
