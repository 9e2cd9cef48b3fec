"""Schemas of the stored tables, and checks on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .types import struct_of as _of

INVENTORY = _of(
    "novel_id string, file_name string, file_stem string, relative_path string, absolute_path string, file_size_bytes bigint, "
    "file_size_mb double, detected_encoding string, read_status string, error_message string, title_guess string, author_guess string, "
    "char_count int, estimated_chapter_count int, content_sha256 string, decode_replacement_chars int, is_duplicate boolean, "
    "duplicate_of string, sample_text string, created_at string"
)
PROFILES = _of(
    "novel_id string, title_guess string, author_guess string, profile_text string, blurb string, char_count int, "
    "estimated_chapter_count int, chapter_excerpt_count int, sampled_chapter_indices array<int>"
)
SPLITS = _of("novel_id string, content_sha256 string, title_guess string, fold string")
EVAL_QUERIES = _of(
    "query_id string, query string, wanted array<string>, unwanted array<string>, anchor_titles array<string>, notes string, "
    "genre string, shape string, constraint_checkable boolean"
)
LLM_CACHE = _of("cache_key string, seq bigint, response string")
JUDGEMENTS = _of(
    "query_id string, query string, system_variant string, title_guess string, novel_id string, notes string, rank int, "
    "relevance_label int, constraint_violation boolean"
)
ANNOTATIONS = _of("query_id string, novel_id string, relevance_label int, constraint_violation boolean, notes string, seq bigint")
SYNTHESIZED = _of(
    "query string, shape string, wanted array<string>, unwanted array<string>, seed_novel_id string, seed_title string, "
    "seed_satisfies_constraint boolean, constraint_checkable boolean"
)
EPISODES = _of(
    "query string, seed_novel_id string, novel_id string, title_guess string, pool_rank int, constraint_terms array<string>, "
    "rule_verdict boolean, prompt string, ref_score double, partner_anchor double"
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, if it has all the columns; else a ValueError before anything runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
