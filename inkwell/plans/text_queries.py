"""Text, chapters, requests and model answers, on texts made of ``documents``.

The tables hold neither books with headings nor model answers, so each query
writes them around the columns of every document, and its SQL says from the
columns what must be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, decide, text
from ..operators import preferences, profiles
from .corpus_queries import _SPACE
from .registry import Catalogue, Tables

CATALOGUE = Catalogue()
_ENDS = "[。！？…”』」)）]"


def _docs(t: Tables) -> DataFrame:
    """Every document with its text on one line, and columns that are never null."""
    line = text.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0b\f\r]+", " "))
    return t("documents").select("doc_id", line.alias("line"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("nowhere")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


_DOCS = rf"""docs AS (SELECT doc_id, {_strip(r"regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')")} AS line, coalesce(text, '') AS text,
  coalesce(source, 'nowhere') AS source, coalesce(lang, 'none') AS lang FROM documents)"""


def _trim_sql(x: str, size: int) -> str:
    window = f"substr({_strip(x)}, 1, {size})"
    cut = f"coalesce(nullif(regexp_extract({window}, '(?s)^(.{{{size // 2 + 1},}}{_ENDS})', 1), ''), {window})"
    return f"CASE WHEN length({_strip(x)}) <= {size} THEN {_strip(x)} ELSE {_strip(cut)} END"


def _str(c: str) -> Column:
    return F.col(c).cast("string")


def _book() -> Column:
    """A front matter, then as many chapters as the id's rest by five says."""
    chapter = lambda i: F.concat(F.lit("第"), i.cast("string"), F.lit("章 "), "source", F.lit("\n"), "lang", F.lit(" "), i.cast("string"), F.lit(" "), "line", F.lit("\n"))
    n = (F.col("doc_id") % 5).cast("int")
    return F.concat(F.lit("front matter\n"), F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), 1, n), chapter), ""))


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, i::INT AS index, '第' || i || '章 ' || source AS title, {_strip("lang || ' ' || i || ' ' || line")} AS text FROM docs, range(1, 6) r(i) WHERE i <= doc_id % 5
UNION ALL SELECT doc_id, 1, '全文', 'front matter' FROM docs WHERE doc_id % 5 = 0""")
def chapter_split(t: Tables) -> DataFrame:
    """The chapters of books, with their whole texts."""
    return _docs(t).select("doc_id", F.explode(profiles.chapters(_book())).alias("c")).select("doc_id", "c.*")


@CATALOGUE.add(f"WITH {_DOCS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_trim_sql('line', 800)} END AS blurb FROM docs")
def synopsis(t: Tables) -> DataFrame:
    """What follows the mark of a synopsis, up to the first heading."""
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit("开头 ")).otherwise(F.lit("内容简介："))
    return _docs(t).select("doc_id", profiles.blurb(F.concat(F.lit("书名\n"), mark, F.substring("line", 1, 5000), F.lit("\n第一章 始\n正文"))).alias("blurb"))


@CATALOGUE.add(f"WITH {_DOCS} SELECT doc_id, {_trim_sql('text', 400)} AS trimmed, substr(text, 1, 64) AS truncated FROM docs")
def sentence_trim(t: Tables) -> DataFrame:
    """Texts cut after a sentence, and cut off."""
    return _docs(t).select("doc_id", text.trim_to_sentence(F.col("text"), 400).alias("trimmed"), text.truncate(F.col("text"), 64).alias("truncated"))


@CATALOGUE.add(f"""WITH {_DOCS}, books AS (SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM docs)
SELECT doc_id, CASE WHEN length(text) <= 2400 THEN text ELSE array_to_string(list_filter([
  {_strip("substr(text, 1, 800)")}, {_strip("substr(text, greatest(length(text) // 2 - 400, 0) + 1, 800)")}, {_strip("substr(text, length(text) - 799, 800)")}], lambda x: x <> ''),
  chr(10) || chr(10) || '[...]' || chr(10) || chr(10)) END AS sample FROM books""")
def text_sample(t: Tables) -> DataFrame:
    """Start, middle and end of every text."""
    return _docs(t).select("doc_id", text.sample_text(F.col("text"), 2400).alias("sample"))


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, source || ' ' || lang || doc_id AS title, CASE WHEN doc_id % 4 IN (1, 2) THEN source END AS author FROM docs""")
def title_author(t: Tables) -> DataFrame:
    """Titles and authors from file names."""
    k, base = F.col("doc_id") % 4, F.concat("source", F.lit(" "), "lang", _str("doc_id"))
    stem = F.when(k == 0, F.concat(base, F.lit("（精校版）"))).when(k == 1, F.concat(base, F.lit(" 作者："), "source")).when(k == 2, F.concat(base, F.lit(" by "), "source"))
    stem = stem.otherwise(F.concat(base, F.lit("【校对版】完本+番外 txt")))
    return _docs(t).select("doc_id", text.title_from_stem(stem).alias("title"), text.author_from_stem(stem).alias("author"))


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, '慢热|' || lang || '|理性|主角' AS positive, CASE WHEN doc_id % 2 = 0 THEN source || '|后宫' ELSE '后宫|' || source END AS negative FROM docs""")
def preference_parse(t: Tables) -> DataFrame:
    """Wanted and unwanted terms of requests."""
    query = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("慢热 不要 "), "source", F.lit("，"), "lang", F.lit(" 慢热、别后宫；理性主角"))).otherwise(
        F.concat(F.lit(" 慢热/避免后宫|"), "lang", F.lit(" 不"), "source", F.lit(" 理性主角 无后宫")))
    parsed = _docs(t).select("doc_id", preferences.parse(query).alias("p"))
    return parsed.select("doc_id", F.array_join("p.positive", "|").alias("positive"), F.array_join("p.negative", "|").alias("negative"))


@CATALOGUE.add(f"WITH {_DOCS} SELECT doc_id, doc_id % 3 <> 0 AS contradicts FROM docs")
def self_contradiction(t: Tables) -> DataFrame:
    """Requests that want, or name besides, what they exclude."""
    k = F.col("doc_id") % 3
    query = F.concat(F.lit("想看 慢热 不要"), "source", F.when(k == 1, F.concat(F.lit(" 但 "), "source")).otherwise(""))
    wanted = F.when(k == 2, F.array("source")).otherwise(F.array(F.lit("慢热")))
    return _docs(t).select("doc_id", preferences.self_contradictory(query, wanted, F.array("source")).alias("contradicts"))


_UNIT = "('0x' || substr(sha1(doc_id || ':' || i), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


@CATALOGUE.add(f"""WITH {_DOCS}, placed AS (SELECT doc_id, i, (i + 0.15::DOUBLE) / 5.0::DOUBLE + {_UNIT} * 0.2::DOUBLE * 0.7::DOUBLE AS x FROM docs, range(0, 4) r(i))
SELECT doc_id, i::INT AS window, round(CASE WHEN abs(x) < 0.08 THEN 0.12 WHEN abs(x - 0.5) < 0.08 THEN 0.62 WHEN abs(x - 1) < 0.08 THEN 0.97 ELSE x END, 4) AS fraction FROM placed""")
def evidence_fractions(t: Tables) -> DataFrame:
    """Where a judge's windows start, apart from those of the profile."""
    found = _docs(t).select("doc_id", F.posexplode(profiles.apart_fractions(_str("doc_id"), 4)).alias("window", "fraction"))
    return found


#: Of sixty chapters the profile has the first four and six more up to the 57th, an even step apart.
_FREE = [i for i in range(60) if i not in (0, 1, 2, 3, *(4 + round(k * 52 / 6) for k in range(1, 7)))]


@CATALOGUE.add(f"""WITH {_DOCS}, drawn AS (SELECT doc_id, i, (i * 50) // 6 AS a, ((i + 1) * 50) // 6 AS b, {_UNIT} AS u FROM docs, range(0, 6) r(i))
SELECT doc_id, string_agg(({_FREE})[a + floor(u * (b - a))::INT + 1], ',' ORDER BY i) AS positions FROM drawn GROUP BY doc_id""")
def evidence_positions(t: Tables) -> DataFrame:
    """Of sixty chapters those that a judge reads, one of each band that the profile left."""
    return _docs(t).select("doc_id", F.array_join(profiles.evidence_positions(_str("doc_id"), F.lit(60)), ",").alias("positions"))


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, {_strip("substr(text, least(floor(length(text) * 0.4::DOUBLE)::INT, greatest(length(text) - 700, 0)) + 1, 700)")} AS passage FROM docs""")
def evidence_window(t: Tables) -> DataFrame:
    """The passage at two fifths of every text."""
    return _docs(t).select("doc_id", profiles.window_at(F.col("text"), F.lit(0.4), 700).alias("passage"))


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _score() -> Column:
    return (F.col("doc_id") % 13 / 10).cast("string")


def _level() -> Column:
    return F.element_at(F.array(F.lit("High"), F.lit(" medium"), F.lit("sure"), F.lit("low")), (F.col("doc_id") % 4 + 1).cast("int"))


_LEVEL_SQL = "['high', 'medium', 'low', 'low'][doc_id % 4 + 1]"


def _quoted(c: str) -> Column:
    return F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)


def _answer() -> Column:
    return _said(
        "<think>maybe {\"llm_match_score\": 9}</think>Here: {\"llm_match_score\": ", _score(), ", \"confidence\": \"", _level(), "\", \"matched_preferences\": [\"", F.col("lang"),
        "\"], \"violated_preferences\": [\"", F.col("source"), "\", 7], \"risk_flags\": [], \"reason\": ", _quoted("line"), "}", F.when(F.col("doc_id") % 2 == 0, " and more {").otherwise(""),
    )


@CATALOGUE.add(f"""WITH {_DOCS}, read AS (SELECT *, doc_id % 13 <= 10 AND doc_id % 4 <> 2 AND length(line) - length(replace(line, chr(123), '')) = length(line) - length(replace(line, chr(125), '')) AS good FROM docs)
SELECT doc_id, CASE WHEN good THEN (doc_id % 13) / 10 END AS score, CASE WHEN good THEN {_LEVEL_SQL} END AS confidence, CASE WHEN good THEN source || '|7' END AS violated, CASE WHEN good THEN line END AS reason FROM read
WHERE NOT regexp_matches(line, '[{{}}]|think>')""")
def strict_verdicts(t: Tables) -> DataFrame:
    """Verdicts as the strict gate reads them from answers that quote a whole text."""
    plain = _docs(t).where(~F.col("line").rlike(r"[{}]|think>"))
    read = plain.select("doc_id", answers.parse_strict(_answer()).alias("v"))
    return read.select("doc_id", "v.score", "v.confidence", F.array_join("v.violated", "|").alias("violated"), "v.reason")


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, least((doc_id % 13) / 10, 1.0) AS score, {_LEVEL_SQL} AS confidence, lang AS matched, CASE WHEN doc_id % 2 = 0 THEN ' and more ' || chr(123) ELSE '' END AS rest FROM docs
WHERE NOT regexp_matches(line, '[{{}}]|think>')""")
def loose_matches(t: Tables) -> DataFrame:
    """The same answers with defaults, and what follows the object."""
    plain = _docs(t).where(~F.col("line").rlike(r"[{}]|think>"))
    read = plain.select("doc_id", answers.parse_match(_answer()).alias("v"), answers.trailing_text(_answer()).alias("rest"))
    return read.select("doc_id", "v.score", "v.confidence", F.array_join("v.matched", "|").alias("matched"), "rest")


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN least(doc_id % 5, 2)::INT END AS label, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 = 0 END AS violation,
  CASE WHEN doc_id % 5 <> 0 THEN source END AS reason, CASE WHEN doc_id % 5 <> 0 THEN {_LEVEL_SQL} END AS confidence FROM docs""")
def judge_answers(t: Tables) -> DataFrame:
    """Labels of a judge; null, never 0, where the answer has no object."""
    flag = F.when(F.col("doc_id") % 3 == 0, F.lit('"Yes"')).otherwise(F.lit("false"))
    told = _said('thoughts</think>{"relevance_label": "', (F.col("doc_id") % 5).cast("string"), '.7", "constraint_violation": ', flag, ', "reason": "', F.col("source"), '", "judge_confidence": "', _level(), '"}')
    read = _docs(t).select("doc_id", answers.parse_judge(F.when(F.col("doc_id") % 5 == 0, F.lit("I cannot {say")).otherwise(told)).alias("v"))
    return read.select("doc_id", "v.label", "v.violation", "v.reason", "v.confidence")


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, 'calm ' || source || ' story' AS query, CASE WHEN doc_id % 2 = 0 THEN 'sent' ELSE 'kw' END AS shape, lang AS wanted, source AS unwanted, doc_id % 3 <> 0 AS satisfies FROM docs""")
def synthesized_queries(t: Tables) -> DataFrame:
    """Generated requests; those too short or with a title are left out."""
    item = lambda query, *more: _said('{"query": "', query, '"', *more, "}")
    good = item(_said(" calm ", F.col("source"), " story "), ', "shape": "', F.when(F.col("doc_id") % 2 == 0, "SENT").otherwise("ballad"), '", "wanted": ["', F.col("lang"), '", " "], "unwanted": [" ', F.col("source"), '"], "seed_satisfies_constraint": ', F.when(F.col("doc_id") % 3 != 0, "true").otherwise("false"))
    told = _said('{"queries": [', item(_said("ab")), ", ", good, ", ", item(_said("like 《", F.col("source"), "》 please")), ', "junk"]}')
    read = _docs(t).select("doc_id", F.explode(answers.parse_synthesis(told)).alias("q"))
    return read.select("doc_id", "q.query", "q.shape", F.array_join("q.wanted", "|").alias("wanted"), F.array_join("q.unwanted", "|").alias("unwanted"), "q.satisfies")


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, 0 AS place, source AS said, 'llm' AS source, 1.0::DOUBLE AS weight FROM docs WHERE doc_id % 4 <> 0
UNION ALL SELECT doc_id, 1, lang, 'domain_hints', 0.9 FROM docs WHERE doc_id % 4 <> 0""")
def expanded_queries(t: Tables) -> DataFrame:
    """Other wordings of a request; none from an answer that cannot be read."""
    told = _said('{"expanded_queries": [{"text": " ', F.col("source"), '", "source": "me", "weight": 7}, {"text": "  "}, {"text": "', F.col("lang"), '", "source": "domain_hints"}]')
    told = F.when(F.col("doc_id") % 4 == 0, told).otherwise(F.concat(told, F.lit("}")))
    read = _docs(t).select("doc_id", F.posexplode(answers.parse_expansion(told)).alias("place", "q"))
    return read.select("doc_id", "place", F.col("q.text").alias("said"), "q.source", "q.weight")


@CATALOGUE.add(f"""WITH {_DOCS} SELECT doc_id, doc_id % 2 = 0 AS truncated, least(greatest((doc_id % 7) / 5 - 0.2::DOUBLE, 0), 1) AS score, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS label,
  CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS verdict, sha256('{{"model": "m", "prompt_hash": "' || sha256(text) || '"}}') AS cache_key FROM docs""")
def answer_fields(t: Tables) -> DataFrame:
    """Whether answers are cut off, their clamped numbers and flags, and the keys they are kept by."""
    k = F.col("doc_id") % 4
    cut = _said("<think>{</think> {\"a\": {\"b\": 1}", F.when(F.col("doc_id") % 2 == 0, "").otherwise("}"))
    label = F.when(k == 0, F.lit("-3")).when(k == 1, F.lit("9.5")).when(k == 2, F.lit("1.9")).otherwise(F.lit("none"))
    said = F.when(k == 0, F.lit(" Yes ")).when(k == 1, F.lit("no"))
    return _docs(t).select(
        "doc_id", text.looks_truncated(cut).alias("truncated"), decide.clamp_score(F.col("doc_id") % 7 / 5 - F.lit(0.2)).alias("score"),
        decide.clamp_label(label).alias("label"), decide.truthy(said).alias("verdict"), decide.cache_key(prompt_hash=F.sha2("text", 256), model=F.lit("m")).alias("cache_key"),
    )
