"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, licenses, licenses_sql, media, mixing, packing, pictures, quality, simhash, substrings, token_files
from .staging import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    docs = mixing.queue(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("taken") * F.col("size")).alias("taken"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold, read back from them."""
    path = f"{fresh_path(spark, 'token-files')}/ids"
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.index_of(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated windows of 20 words."""
    kept = substrings.drop_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy that stays for each document."""
    return exact.label_copies(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The co-trained quality scores of all documents."""
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_good", "p_content", "p_metadata", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the least document of its component."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which images the edited copies of every twentieth image come from."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = pictures.images(vectors.where("vec_id % 20 = 0"), edit=True)
    return media.find_copies(asked, pictures.images(vectors))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the conversations as read back from the formatted text."""
    hard = "</s>[INST] ok [/INST]"
    one = spark.sql(f"SELECT -1L AS conv_id, i AS turn, element_at(array('user', 'assistant'), i) AS role, '{hard}' AS text FROM (SELECT explode(array(1, 2)) AS i)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(one)
    read = chat.format_chats(turns).withColumn("turns", chat.read_chats(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.filter(F.zip_with("turns", "loss", lambda t, on: F.when(on, t["text"])), lambda x: x.isNotNull())
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.array_join(trained, "").alias("trained"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, laid out in directories by its columns."""
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", F.expr(licenses_sql.document_path()).alias("path"), "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_packing": op2_packing,
        "op3_token_files": op3_token_files,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_quality": op6_quality,
        "op7_simhash": op7_simhash,
        "op8_media_copies": op8_media_copies,
        "op9_chat_format": op9_chat_format,
        "op10_license_scan": op10_license_scan,
    }


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY no_source, source) - 1) % 3) + 1 AS weight, 3 * source_size AS cap FROM totals),
placed AS (
  SELECT *, row_number() OVER o AS place,
    ((SELECT sum(source_size) FROM totals)
      - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / weight, no_source, source)),
first AS (SELECT place AS p, level AS l FROM placed WHERE weight * level < cap ORDER BY place LIMIT 1),
targets AS (
  SELECT no_source, source, source_size,
    CASE WHEN p IS NULL OR place < p THEN cap::DOUBLE ELSE weight * l END AS target
  FROM placed LEFT JOIN first ON TRUE),
queued AS (
  SELECT s.*, source_size, target,
    (sum(size) OVER (PARTITION BY s.no_source, s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS until
  FROM sized s JOIN targets t ON s.no_source = t.no_source AND s.source = t.source),
copies AS (
  SELECT doc_id, no_source, source, k, size, until, turn, target, (turn * source_size + until)::DOUBLE / target AS finish
  FROM queued, range(3) r(turn) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, no_source, source, until, k, turn ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM sized) AS inside FROM copies),
ends AS (
  SELECT no_source, source, any_value(target) AS goal, coalesce(sum(size) FILTER (inside), 0) AS words FROM ordered GROUP BY ALL),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY no_source, source, inside ORDER BY finish, until, k, turn) AS n FROM ordered JOIN ends USING (no_source, source)),
cut AS (
  SELECT doc_id, count(*) AS times FROM nth
  WHERE inside OR (n = 1 AND abs(words + size - goal) < abs(words - goal)) GROUP BY 1)
SELECT doc_id, size, source_size, target, (coalesce(times, 0) * size)::BIGINT AS taken FROM queued LEFT JOIN cut USING (doc_id)
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY said ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY 1),
kept AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
    list_filter(words, lambda x, j: js IS NULL OR NOT list_contains(js, j)) AS rest
  FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""

OP5_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM (
  SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
"""

OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 2, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|<?/?SYS>>|\|\w+\|>|/?INST\])', '\1\\\2\3', 'g')) AS n
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN before IS NULL THEN 24 + length(role) WHEN before = role THEN 10 ELSE 24 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op9_chat_format": OP9_SQL, "op10_license_scan": licenses_sql.oracle()}
