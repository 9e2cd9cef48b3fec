"""Inventory, cleaning, duplicates, folds, densities and segments of ``documents``.

A document stands for a book: its source for the author, its first two words
for the title, its lines for chapters. Vocabularies and cuts are neutral ones,
as the tables hold no Chinese.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decide, text
from ..operators import corpus, evaluation, logs, preferences, profiles
from .registry import Catalogue, Tables

CATALOGUE = Catalogue()
WORDS = ["the", "and", "und", "les", "que"]
FORMS = {"english": ("the", "and"), "german": ("und",), "french": ("les", "que")}
CUTS = {"violating": 300.0, "clean": 100.0}
MARKS = {"edge_marks": ("licen[cs]e", "copyright"), "inner_marks": ("all rights reserved",)}
ADS = (r"https?://\S+",)

#: Unicode white space in RE2's notation.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NOVELS_SQL = rf"""
novels AS (
  SELECT doc_id, coalesce(text, '') AS text, source, lang, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[{_SPACE}]+', '', 'g')) AS content,
    regexp_extract(coalesce(text, ''), '^[^ \n]+ [^ \n]+') AS title
  FROM documents)"""
_EXACT_SQL = f"{NOVELS_SQL}, exact AS (SELECT *, min(doc_id) OVER (PARTITION BY content) AS first FROM novels)"
_NEAR_SQL = f"""{_EXACT_SQL},
longest AS (
  SELECT trim(title) AS t, trim(source) AS a, arg_min(doc_id, (-chars, doc_id)) AS best, max(chars) AS most
  FROM exact WHERE first = doc_id AND trim(source) <> '' AND title <> '' GROUP BY ALL),
near AS (
  SELECT exact.*, best, coalesce(first = doc_id AND best <> doc_id AND most > 0 AND (most - chars)::DOUBLE / most <= 0.05, false) AS is_near
  FROM exact LEFT JOIN longest ON trim(title) = t AND trim(source) = a AND first = doc_id AND title <> '')"""
FOLDS_SQL = rf"""{_EXACT_SQL},
folds AS (
  SELECT doc_id, content AS content_sha256,
    CASE WHEN ('0x' || substr(sha256('fold:' || content), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.2 THEN 'eval' ELSE 'train' END AS fold
  FROM exact WHERE first = doc_id)"""


def novels(t: Tables) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    return t("documents").select(
        "doc_id", whole.alias("text"), "source", "lang", F.length(whole).alias("chars"), text.fingerprint(whole).alias("content"),
        F.regexp_extract(whole, r"^[^ \n]+ [^ \n]+", 0).alias("title"),
    )


def _exact(t: Tables) -> DataFrame:
    return corpus.exact_duplicates(novels(t), key="doc_id", content="content", order="doc_id")


def _near(t: Tables) -> DataFrame:
    return corpus.near_duplicates(_exact(t), key="doc_id", title="title", author="source", length="chars", order="doc_id")


def folds(t: Tables) -> DataFrame:
    rows = _exact(t).select(F.col("doc_id").alias("novel_id"), F.col("content").alias("content_sha256"), F.lit("ok").alias("read_status"), "is_duplicate")
    return corpus.splits(rows).withColumnRenamed("novel_id", "doc_id")


def _density_sql(word: str, column: str = "text") -> str:
    size = f"length({column})"
    return f"CASE WHEN {size} > 0 THEN ({size} - length(replace({column}, '{word}', '')))::DOUBLE / {len(word)} / {size} * 1e5 ELSE 0 END"


def _normalized_sql(x: str) -> str:
    for pattern, to in ((r"[\x{feff}\x00]", "''"), (r"\r\n?", "chr(10)"), (r"\t", "' '"), (r"[ \x{3000}]{2,}", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (f"^[{_SPACE}]+|[{_SPACE}]+$", "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


_EDGE = "(i - 1 < 120 OR i > len(parts) - 120)"
_HIT = "CASE WHEN ({0} - 1 < 120 OR {0} > len(parts) - 120) THEN regexp_matches({1}, '(?i)licen[cs]e|copyright') ELSE regexp_matches({1}, '(?i)all rights reserved') END"
_BESIDE = "coalesce(({0} - 1 < 120 OR {0} > len(parts) - 120) AND " + _HIT + ", false)"
_GONE_SQL = (
    f"({_HIT.format('i', 'x')} OR (regexp_matches(regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), '^[=\\-*_＿—～＊]{{8,}}$') AND ("
    f"(i > 1 AND {_BESIDE.format('(i - 1)', 'parts[i - 1]')}) OR (i < len(parts) AND {_BESIDE.format('(i + 1)', 'parts[i + 1]')}))))"
)
_PARTS_SQL = f"{NOVELS_SQL}, split AS (SELECT doc_id, string_split({_normalized_sql('text')}, chr(10)) AS parts FROM novels)"


@CATALOGUE.add(f"WITH {NOVELS_SQL} SELECT doc_id, content AS content_sha256, chars::INT AS char_count FROM novels")
def content_fingerprint(t: Tables) -> DataFrame:
    """The white-space-insensitive hash of every text."""
    return novels(t).select("doc_id", F.col("content").alias("content_sha256"), F.col("chars").alias("char_count"))


@CATALOGUE.add(f"WITH {_EXACT_SQL} SELECT doc_id, first <> doc_id AS is_duplicate, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM exact")
def exact_dedup(t: Tables) -> DataFrame:
    """Which documents repeat the content of an earlier one."""
    return _exact(t).select("doc_id", "is_duplicate", "duplicate_of")


@CATALOGUE.add(f"""WITH {_NEAR_SQL} SELECT doc_id, is_near, first <> doc_id OR is_near AS is_duplicate,
  CASE WHEN is_near THEN best WHEN first <> doc_id THEN first END AS duplicate_of FROM near""")
def near_dedup(t: Tables) -> DataFrame:
    """Which share title, author and length with a longer one."""
    return _near(t).select("doc_id", "is_near", "is_duplicate", "duplicate_of")


@CATALOGUE.add(f"""WITH {_NEAR_SQL} SELECT count(*) FILTER (first <> doc_id) AS exact_duplicates, count(*) FILTER (is_near) AS near_duplicates,
  count(DISTINCT CASE WHEN is_near THEN best WHEN first <> doc_id THEN first END) AS originals,
  count(title) FILTER (first = doc_id AND NOT is_near) - count(DISTINCT title) FILTER (first = doc_id AND NOT is_near) AS title_collisions FROM near""")
def dedup_report(t: Tables) -> DataFrame:
    return corpus.duplicate_report(_near(t), title="title", status=None)


@CATALOGUE.add(f"WITH {FOLDS_SQL} SELECT * FROM folds")
def fold_assign(t: Tables) -> DataFrame:
    """The fold of every document that duplicates none."""
    return folds(t)


@CATALOGUE.add(f"""WITH {FOLDS_SQL} SELECT count(*) AS rows, count(*) FILTER (fold = 'train') AS train_rows, count(*) FILTER (fold = 'eval') AS eval_rows,
  round(avg((fold = 'eval')::INT), 6) AS eval_share FROM folds""")
def fold_report(t: Tables) -> DataFrame:
    return corpus.fold_report(folds(t)).withColumn("eval_share", F.round("eval_share", 6))


@CATALOGUE.add(f"""WITH {FOLDS_SQL}, a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT (SELECT count(*) FROM a) AS train_size, (SELECT count(*) FROM b) AS eval_size, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS overlap,
  (SELECT count(*) FROM a JOIN folds USING (doc_id) WHERE fold = 'eval') AS eval_in_train, (SELECT count(*) FROM b JOIN folds USING (doc_id) WHERE fold = 'train') AS train_in_eval""")
def leakage_report(t: Tables) -> DataFrame:
    """How two sets of labelled documents overlap and respect the folds."""
    labels = t("labels")
    return corpus.leakage(labels.where("quality = 1"), labels.where("toxic = 1"), folds(t), key="doc_id")


@CATALOGUE.add(f"WITH {NOVELS_SQL} SELECT doc_id, chars::INT AS char_count, {', '.join(f'round({_density_sql(w)}, 6) AS {w}' for w in WORDS)} FROM novels")
def term_density_wide(t: Tables) -> DataFrame:
    """Occurrences of each word per 100,000 characters."""
    table = corpus.density_table(novels(t), WORDS, key="doc_id")
    return table.withColumns({w: F.round(w, 6) for w in WORDS})


@CATALOGUE.add(f"""WITH {NOVELS_SQL}, d AS (SELECT doc_id, {_density_sql('the')} + {_density_sql('and')} AS english, {_density_sql('und')} AS german FROM novels),
g AS (SELECT *, greatest(english, german) AS top FROM d)
SELECT doc_id, round(english, 6) AS english, CASE WHEN top >= 300 THEN true WHEN top <= 100 THEN false END AS violates FROM g""")
def merged_density_verdict(t: Tables) -> DataFrame:
    """The three-valued verdict on two terms, one with two surface forms."""
    table = corpus.density_table(novels(t), WORDS, key="doc_id")
    rule = decide.rule_verdict(("english", "german", "unknown"), F.col, FORMS, **CUTS)
    return table.select("doc_id", F.round(decide.merged_density("english", F.col, FORMS), 6).alias("english"), rule.alias("violates"))


@CATALOGUE.add(f"""WITH {NOVELS_SQL}, d AS (SELECT {', '.join(f'{_density_sql(w)} AS "{w}"' for w in WORDS)} FROM novels), u AS (UNPIVOT d ON {', '.join(f'"{w}"' for w in WORDS)} INTO NAME term VALUE d)
SELECT term, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(max(d), 6) AS max,
  round(avg((d >= 3)::INT), 6) AS violating_share, round(avg((d <= 1)::INT), 6) AS clean_share FROM u GROUP BY term""")
def density_summary(t: Tables) -> DataFrame:
    out = corpus.density_summary(corpus.density_table(novels(t), WORDS, key="doc_id"), WORDS)
    return out.select("term", *[F.round(c, 6).alias(c) for c in ("median", "p90", "max", "violating_share", "clean_share")])


@CATALOGUE.add(f"""WITH {_PARTS_SQL}, kept AS (SELECT doc_id, list_filter(list_filter(parts, lambda x, i: NOT {_GONE_SQL}), lambda x: NOT regexp_matches(x, '(?i)https?://\\S+')) AS rest FROM split),
cleaned AS (SELECT doc_id, {_normalized_sql("array_to_string(rest, chr(10))")} AS c FROM kept)
SELECT doc_id, length(c)::INT AS clean_chars, sha256(c) AS clean_sha256 FROM cleaned""")
def clean_lines(t: Tables) -> DataFrame:
    """Texts without licence lines and the separators beside them."""
    cleaned = novels(t).select("doc_id", text.clean(F.col("text"), **MARKS, ads=ADS).alias("c"))
    return cleaned.select("doc_id", F.length("c").alias("clean_chars"), F.sha2("c", 256).alias("clean_sha256"))


@CATALOGUE.add(f"""WITH {_PARTS_SQL} SELECT doc_id, len(parts)::INT AS n_lines, len(list_filter(parts, lambda x, i: {_GONE_SQL}))::INT AS removed_lines,
  len(list_filter(parts, lambda x: regexp_matches(x, '(?i)licen[cs]e|copyright'))) > 0 AS marked FROM split""")
def boilerplate_stats(t: Tables) -> DataFrame:
    """How many lines cleaning removes, and whether marks occur at all."""
    rows = novels(t).select("doc_id", text.normalize_whitespace(F.col("text")).alias("n"))
    marked = text.has_boilerplate(F.col("n"), MARKS["edge_marks"])
    return rows.select("doc_id", F.size(text.lines(F.col("n"))).alias("n_lines"), text.boilerplate_lines(F.col("n"), **MARKS).alias("removed_lines"), marked.alias("marked"))


@CATALOGUE.add(f"""WITH {_PARTS_SQL}, flat AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)
SELECT doc_id, (i - 1)::INT AS segment, length(parts[i])::INT AS chars, sha256(parts[i]) AS segment_sha256 FROM flat WHERE length(parts[i]) >= 20""")
def line_segments(t: Tables) -> DataFrame:
    """Lines as segments, those of 20 characters or more."""
    rows = novels(t).select("doc_id", F.posexplode(text.lines(text.normalize_whitespace(F.col("text")))).alias("segment", "said"))
    return rows.where(F.length("said") >= 20).select("doc_id", "segment", F.length("said").alias("chars"), F.sha2("said", 256).alias("segment_sha256"))


@CATALOGUE.add(f"""WITH {_PARTS_SQL}, n AS (SELECT doc_id, len(parts) AS n, greatest(1, floor(len(parts) * 0.95::DOUBLE)::INT) AS usable FROM split),
h AS (SELECT *, least(10, usable) AS count, least(4, usable) AS head FROM n),
s AS (SELECT *, count - head AS left_, (usable - 1 - head)::DOUBLE / nullif(count - head, 0) AS step FROM h)
SELECT doc_id, n::INT AS n_segments, array_to_string(CASE WHEN usable - head <= left_ THEN range(0, least(head + left_, usable))
  ELSE list_sort(list_distinct(list_concat(range(0, head), list_transform(range(1, left_ + 1), lambda i: least(round_even(head + i * step, 0)::BIGINT, usable - 1))))) END, ',') AS positions FROM s""")
def segment_sampling(t: Tables) -> DataFrame:
    """Opening segments and others spread over a text, its end left out."""
    rows = novels(t).select("doc_id", F.size(text.lines(text.normalize_whitespace(F.col("text")))).alias("n_segments"))
    return rows.select("doc_id", "n_segments", F.array_join(profiles.sampled_positions(F.col("n_segments")), ",").alias("positions"))


def _inventory(t: Tables) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return corpus.inventory(
        t("documents").select(
            path.alias("relative_path"), path.alias("absolute_path"), F.octet_length(whole).cast("long").alias("file_size_bytes"), "text",
            F.lit("utf-8").alias("encoding"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("replacements"),
        )
    )


_INVENTORY_SQL = rf"""inv AS (
  SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, doc_id::VARCHAR AS stem, text, strlen(coalesce(text, '')) AS bytes,
    len(list_distinct(regexp_extract_all(coalesce(text, ''), '(?im)^\s*chapter\s+\d+\b'))) AS chapters FROM documents)"""


@CATALOGUE.add(rf"""WITH {_INVENTORY_SQL} SELECT sha1(path) AS novel_id, stem AS file_stem, stem AS title_guess, length(coalesce(text, ''))::INT AS char_count, chapters::INT AS estimated_chapter_count,
  CASE WHEN text IS NULL THEN '' ELSE sha256(regexp_replace(text, '[{_SPACE}]+', '', 'g')) END AS content_sha256, CASE WHEN text IS NULL THEN 'failed' ELSE 'ok' END AS read_status FROM inv""")
def inventory(t: Tables) -> DataFrame:
    """The inventory of all documents as if each were a file."""
    return _inventory(t).select("novel_id", "file_stem", "title_guess", "char_count", "estimated_chapter_count", "content_sha256", "read_status")


@CATALOGUE.add(rf"""WITH {_INVENTORY_SQL} SELECT count(*) AS files, count(text) AS readable, count(*) - count(text) AS failed, round(sum(round(bytes / 1048576, 4)), 3) AS megabytes,
  round(avg(chapters) FILTER (text IS NOT NULL), 6) AS mean_chapters FROM inv""")
def inventory_summary(t: Tables) -> DataFrame:
    out = corpus.inventory_summary(_inventory(t))
    return out.withColumns({"megabytes": F.round("megabytes", 3), "mean_chapters": F.round("mean_chapters", 6)})


@CATALOGUE.add(f"""WITH {_EXACT_SQL} SELECT CASE WHEN quality = 0 THEN 'failed' WHEN first <> e.doc_id THEN 'duplicate' WHEN toxic = 1 THEN 'missing' ELSE 'ok' END AS status, count(*) AS n
FROM exact e LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def profile_status(t: Tables) -> DataFrame:
    """How many documents have no profile, by the first reason that counts."""
    rows = _exact(t).join(t("labels"), "doc_id", "left").withColumns(
        {"read_status": F.when(F.col("quality") == 0, "failed").otherwise("ok"), "file_exists": ~F.coalesce(F.col("toxic") == 1, F.lit(False))}
    )
    return rows.groupBy(corpus.profile_status(rows).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@CATALOGUE.add(f"WITH {NOVELS_SQL} SELECT doc_id AS novel_id, chars::INT AS chars FROM novels WHERE doc_id IS NOT NULL AND chars >= 50")
def index_profile_filter(t: Tables) -> DataFrame:
    """The texts that are long enough for an index."""
    rows = novels(t).select(F.col("doc_id").alias("novel_id"), F.col("text").alias("profile_text"), "chars")
    return corpus.rows_for_index(rows).select("novel_id", "chars")


@CATALOGUE.add(rf"""WITH {FOLDS_SQL}, anchors AS (SELECT DISTINCT regexp_extract(text, '^[^ \n]+') AS anchor FROM benchmark),
normal AS (SELECT anchor, lower(regexp_replace(anchor, '[《》〈〉「」『』\[\]【】{_SPACE}_\-]+', '', 'g')) AS a FROM anchors),
titles AS (SELECT doc_id, lower(regexp_replace(title, '[《》〈〉「」『』\[\]【】{_SPACE}_\-]+', '', 'g')) AS b FROM novels),
first AS (SELECT anchor, min(doc_id) AS doc_id FROM normal JOIN titles ON a <> '' AND b <> '' AND starts_with(b, a) GROUP BY anchor)
SELECT anchor, fold FROM first JOIN folds USING (doc_id)""")
def title_normalise_prefix(t: Tables) -> DataFrame:
    """The fold of the first title that begins with an anchor."""
    queries = t("benchmark").select(F.array(F.regexp_extract("text", r"^[^ \n]+", 0)).alias("anchor_titles"))
    titles = novels(t).select("doc_id", F.col("title").alias("title_guess"))
    return evaluation.anchor_folds(queries, titles, folds(t), order="doc_id", key="doc_id")


_SPLIT_SQL = rf"list_filter(list_distinct(string_split_regex(trim(text), '[{_SPACE},，、;；/|]+')), lambda x: length(x) >= 2)"


@CATALOGUE.add(f"SELECT item_id, len({_SPLIT_SQL})::INT AS n_tokens, array_to_string(list_sort({_SPLIT_SQL}), ' ') AS tokens FROM benchmark")
def query_tokens(t: Tables) -> DataFrame:
    """The distinct tokens of every benchmark item."""
    rows = t("benchmark").select("item_id", text.query_tokens(F.col("text")).alias("tokens"))
    return rows.select("item_id", F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


@CATALOGUE.add(f"""WITH said AS (SELECT conv_id, turn, {_SPLIT_SQL} AS a FROM conversations WHERE text IS NOT NULL), held AS (SELECT item_id, {_SPLIT_SQL} AS b FROM benchmark)
SELECT DISTINCT conv_id, turn FROM said, held WHERE len(a) >= 2 AND len(b) >= 2 AND len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) >= 0.4""")
def overlap_leak(t: Tables) -> DataFrame:
    """Turns whose tokens overlap those of a benchmark item."""
    said = t("conversations").select(F.struct("conv_id", "turn").alias("at"), text.query_tokens(F.col("text")).alias("tokens"))
    held = t("benchmark").select(F.col("item_id").alias("ref"), text.query_tokens(F.col("text")).alias("tokens"))
    return preferences.overlapping(said, held, "tokens", key="at", threshold=0.4, least=2).select("at.conv_id", "at.turn")


@CATALOGUE.add("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_write_wins(t: Tables) -> DataFrame:
    """The last event of each user and type, as a log is replayed."""
    return logs.latest(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], seq="event_id")


@CATALOGUE.add("SELECT doc_id, sha256(coalesce(text, '')) AS cache_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_cache(t: Tables) -> DataFrame:
    """Documents that no label is known for."""
    rows = logs.missing(t("documents").select("doc_id", "text"), t("labels"), key="doc_id")
    return rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cache_key"))


@CATALOGUE.add("""WITH costs AS (SELECT doc_id, source, length(coalesce(text, ''))::BIGINT AS cost FROM documents),
spent AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM costs)
SELECT doc_id, source, spent_before, spent_before >= 20000 AS skipped FROM spent""")
def budget_cap(t: Tables) -> DataFrame:
    """What each source's budget pays for, in the order of ids."""
    items = t("documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))
    return logs.within_budget(items, F.col("cost"), 20000, "doc_id", group="source").select("doc_id", "source", F.col("spent_before").cast("long").alias("spent_before"), "skipped")


@CATALOGUE.add("""SELECT role, sum(length(coalesce(text, '')))::BIGINT AS prompt_chars, round(sum(length(coalesce(text, '')) * 0.4::DOUBLE / 1e6), 9) AS cost FROM conversations GROUP BY role""")
def usage_cost(t: Tables) -> DataFrame:
    """Spend by role if each character were a prompt token."""
    n = F.length(F.coalesce("text", F.lit("")))
    return t("conversations").groupBy("role").agg(F.sum(n).alias("prompt_chars"), F.round(F.sum(logs.usage_cost(n, F.lit(0), 0.4, 1.6)), 9).alias("cost"))
