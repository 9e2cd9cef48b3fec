"""Vector search, merging, selection, fusion and evaluation over ``embeddings``.

Every vector whose id is divisible by 20 is a query against all vectors. The
queries of one label are the variants of one reader's request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decide, text
from ..operators import corpus, evaluation, logs, ranking, retrieval
from .registry import Catalogue, Tables

CATALOGUE = Catalogue()
_SOURCES = "CASE (query_id / 20)::BIGINT % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'domain_hints' ELSE 'llm' END"

KNN_SQL = """
pairs AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""
MERGED_SQL = f"""{KNN_SQL},
hits AS (SELECT *, {_SOURCES} AS source, CASE (query_id / 20)::BIGINT % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS weight FROM ranked WHERE rank <= 10),
totals AS (SELECT label AS query_label, count(*) AS n FROM embeddings WHERE vec_id % 20 = 0 GROUP BY 1),
sourced AS (SELECT query_label, vec_id, string_agg(source, ',' ORDER BY s, r) AS sources FROM (
  SELECT query_label, vec_id, source, min(query_id) AS s, min(rank) AS r FROM hits GROUP BY ALL) GROUP BY ALL),
grouped AS (
  SELECT query_label, vec_id, any_value(label) AS label, max(score) AS best_score, arg_max(rank, (score, -query_id)) AS best_rank, count(*) AS matched,
    max(weight) AS source_weight, arg_min(rank, query_id) AS r0, min(query_id) AS s0 FROM hits GROUP BY ALL),
scored AS (
  SELECT g.*, sources, 0.7::DOUBLE * best_score + 0.2::DOUBLE * least(matched::DOUBLE / n, 1.0) + 0.1::DOUBLE * source_weight AS retrieval_score
  FROM grouped g JOIN totals USING (query_label) JOIN sourced USING (query_label, vec_id)),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY retrieval_score DESC, s0, r0, vec_id) AS retrieval_rank FROM scored)"""
SELECTED_SQL = f"""{MERGED_SQL},
views AS (
  SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY retrieval_score DESC, retrieval_rank) AS r,
    row_number() OVER (PARTITION BY query_label ORDER BY best_score DESC, retrieval_rank) AS s,
    row_number() OVER (PARTITION BY query_label ORDER BY best_rank, retrieval_rank) AS b, least(count(*) OVER (PARTITION BY query_label), 8) AS size FROM merged),
quotas(size, q1, q2, q3) AS (VALUES (1, 1, 0, 0), (2, 1, 1, 0), (3, 1, 1, 1), (4, 1, 2, 1), (5, 2, 2, 1), (6, 3, 2, 1), (7, 3, 3, 1), (8, 4, 3, 1)),
named AS (SELECT *, r <= q1 AS h1, s <= q2 AS h2, b <= q3 AS h3 FROM views JOIN quotas USING (size)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY CASE WHEN h1 THEN 0 WHEN h2 THEN 1 WHEN h3 THEN 2 ELSE 3 END, CASE WHEN h1 THEN r WHEN h2 THEN s WHEN h3 THEN b ELSE r END) AS place,
    concat_ws('|', CASE WHEN h1 THEN 'retrieval_score_top' END, CASE WHEN h2 THEN 'semantic_score_top' END, CASE WHEN h3 THEN 'best_faiss_rank_top' END,
      CASE WHEN h1::INT + h2::INT + h3::INT > 1 THEN 'already_selected_multiple_reasons' END) AS given FROM named),
selected AS (SELECT *, CASE WHEN given = '' THEN 'retrieval_score_top' ELSE given END AS reasons FROM placed WHERE place <= 8)"""
_VERDICTS_SQL = """
judged AS (
  SELECT m.*, CASE WHEN s.vec_id IS NULL THEN NULL WHEN m.label = m.query_label THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END AS match_score,
    CASE m.vec_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS sure, s.vec_id IS NOT NULL AS asked,
    CASE WHEN m.vec_id % 7 = 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN m.vec_id % 11 = 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN m.vec_id % 3 = 2 THEN 0.05::DOUBLE ELSE 0 END AS risk
  FROM merged m LEFT JOIN selected s USING (query_label, vec_id)),
pool AS (
  SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (best_score - lo) / (hi - lo) END AS semantic FROM (
    SELECT *, min(best_score) OVER w AS lo, max(best_score) OVER w AS hi, coalesce(avg(match_score) OVER w, 0.5) AS mean_match,
      coalesce(avg(CASE WHEN asked THEN sure END) OVER w, 0.3) AS mean_sure FROM judged WINDOW w AS (PARTITION BY query_label)))"""


def _fused_sql(guess: str) -> str:
    return f"""{SELECTED_SQL}, {_VERDICTS_SQL},
final AS (SELECT *, CASE WHEN asked THEN 0.4::DOUBLE * semantic + 0.5::DOUBLE * match_score + 0.1::DOUBLE * sure - risk ELSE {guess} END AS final_score FROM pool),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY round(final_score, 9) DESC, retrieval_rank) AS final_rank FROM final)"""


FUSED_SQL = _fused_sql("0.4::DOUBLE * semantic + 0.5::DOUBLE * mean_match + 0.1::DOUBLE * mean_sure")
RESULTS_SQL = f"""{FUSED_SQL},
results AS (
  SELECT *, 'L' || label || '-' || vec_id AS title_guess, CASE abs(label - query_label) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS relevance_label, vec_id % 7 = 0 AS constraint_violation FROM (
    SELECT query_label AS query_id, 'baseline' AS system_variant, retrieval_rank AS rank, vec_id, label, query_label FROM merged
    UNION ALL SELECT query_label, 'full', final_rank, vec_id, label, query_label FROM fused))"""


def knn(t: Tables, k: int = 10) -> DataFrame:
    """query_id, query_label, vec_id, label, score, rank."""
    vectors = t("embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), "embedding")
    found = retrieval.search(queries, vectors, k)
    named = found.join(vectors.select("vec_id", "label"), "vec_id")
    return named.join(queries.select("query_id", "query_label"), "query_id").select("query_id", "query_label", "vec_id", "label", "score", "rank")


def merged(t: Tables) -> DataFrame:
    hits = knn(t)
    turn = F.pmod((F.col("query_id") / 20).cast("long"), F.lit(3))
    hits = hits.select(
        "query_label", "vec_id", "label", F.col("query_id").alias("seq"), F.when(turn == 0, "raw").when(turn == 1, "domain_hints").otherwise("llm").alias("source"),
        F.when(turn == 0, 1.0).when(turn == 1, 0.8).otherwise(0.9).alias("weight"), "rank", "score",
    )
    totals = t("embeddings").where("vec_id % 20 = 0").groupBy(F.col("label").alias("query_label")).agg(F.count(F.lit(1)).alias("total"))
    out = retrieval.merge(hits.join(totals, "query_label"), group=["query_label"], total=F.col("total"), key="vec_id")
    return out.join(t("embeddings").select("vec_id", "label"), "vec_id").withColumn("seq", F.col("retrieval_rank"))


def selected(t: Tables) -> DataFrame:
    return ranking.select_for_scoring(merged(t), 8, group=["query_label"], key="vec_id")


def fused(t: Tables, policy: str = "impute") -> DataFrame:
    """All candidates; those selected have the stand-in's match scores."""
    every = merged(t)
    asked = ranking.select_for_scoring(every, 8, group=["query_label"], key="vec_id").select("query_label", "vec_id", F.lit(True).alias("asked"))
    rows = every.join(asked, ["query_label", "vec_id"], "left")

    def told(value):
        return F.when(F.col("asked"), value)

    none = F.array().cast("array<string>")
    third = F.col("vec_id") % 3
    rows = rows.withColumns(
        {
            "match_score": told(F.when(F.col("label") == F.col("query_label"), 0.9).otherwise(0.2)),
            "confidence": told(F.when(third == 0, "high").when(third == 1, "medium").otherwise("low")),
            "violated": told(F.when(F.col("vec_id") % 7 == 0, F.array(F.lit("x"))).otherwise(none)),
            "flags": told(F.when(F.col("vec_id") % 11 == 0, F.array(F.lit("Boilerplate text"))).otherwise(none)),
        }
    )
    return ranking.fuse(rows, group=["query_label"], policy=policy)


def results(t: Tables) -> DataFrame:
    """Two systems' ranked rows with labels."""
    rows = fused(t)
    one = rows.select(F.lit("baseline").alias("system_variant"), F.col("retrieval_rank").alias("rank"), "vec_id", "label", "query_label")
    both = one.unionByName(rows.select(F.lit("full").alias("system_variant"), F.col("final_rank").alias("rank"), "vec_id", "label", "query_label"))
    gap = F.abs(F.col("label") - F.col("query_label"))
    return both.select(
        F.col("query_label").alias("query_id"), "system_variant", "rank", F.col("vec_id").alias("novel_id"), "label",
        F.concat(F.lit("L"), F.col("label"), F.lit("-"), F.col("vec_id")).alias("title_guess"),
        F.when(gap == 0, 2).when(gap == 1, 1).otherwise(0).alias("relevance_label"), (F.col("vec_id") % 7 == 0).alias("constraint_violation"),
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@CATALOGUE.add(f"WITH {KNN_SQL} SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 10")
def knn_topk(t: Tables) -> DataFrame:
    """The ten nearest vectors of every query, exactly."""
    return _rounded(knn(t).select("query_id", "vec_id", "score", "rank"), "score")


@CATALOGUE.add(f"""WITH {MERGED_SQL} SELECT query_label, vec_id, round(best_score, 6) AS best_score, best_rank::INT AS best_rank, matched, source_weight, sources,
  round(retrieval_score, 6) AS retrieval_score, retrieval_rank::INT AS retrieval_rank FROM merged""")
def multi_query_merge(t: Tables) -> DataFrame:
    """The candidates of each request, merged over its queries."""
    out = merged(t).select("query_label", "vec_id", "best_score", "best_rank", "matched", "source_weight", F.array_join("sources", ",").alias("sources"), "retrieval_score", "retrieval_rank")
    return _rounded(out, "best_score", "retrieval_score")


@CATALOGUE.add(f"WITH {MERGED_SQL} SELECT source, count(*) AS candidates FROM (SELECT DISTINCT query_label, vec_id, source FROM hits) GROUP BY source")
def source_counts(t: Tables) -> DataFrame:
    return retrieval.source_counts(merged(t))


@CATALOGUE.add(f"WITH {MERGED_SQL} SELECT count(*) FILTER (contains('L' || label || '-' || vec_id, 'L3')) > 0 AS found, min(retrieval_rank) FILTER (contains('L' || label || '-' || vec_id, 'L3'))::INT AS first_rank FROM merged")
def title_lookup(t: Tables) -> DataFrame:
    """Whether and where a title stands among the candidates."""
    rows = merged(t).withColumn("title_guess", F.concat(F.lit("L"), F.col("label"), F.lit("-"), F.col("vec_id")))
    return retrieval.title_status(rows, "L3")


@CATALOGUE.add(f"WITH {SELECTED_SQL} SELECT query_label, vec_id, place::INT AS place, reasons FROM selected")
def selection_quotas(t: Tables) -> DataFrame:
    """Which candidates of a request are worth scoring, and why."""
    return selected(t).select("query_label", "vec_id", "place", F.array_join("reasons", "|").alias("reasons"))


@CATALOGUE.add(f"""WITH {FUSED_SQL} SELECT query_label, vec_id, round(semantic, 6) AS semantic, CASE WHEN asked THEN round(risk, 6) ELSE 0 END AS risk_penalty,
  CASE WHEN NOT asked THEN round(mean_match, 6) END AS imputed_match, round(final_score, 6) AS final_score, final_rank::INT AS final_rank FROM fused""")
def fusion_impute(t: Tables) -> DataFrame:
    """Final ranks; what was not scored counts as the average."""
    out = fused(t).select("query_label", "vec_id", "semantic", "risk_penalty", "imputed_match", "final_score", "final_rank")
    return _rounded(out, "semantic", "risk_penalty", "imputed_match", "final_score")


@CATALOGUE.add(f"""WITH {_fused_sql("0.35::DOUBLE * semantic + 0.05::DOUBLE * least(matched / 5.0::DOUBLE, 1.0)")}
SELECT query_label, vec_id, round(final_score, 6) AS final_score, final_rank::INT AS final_rank FROM fused""")
def fusion_legacy(t: Tables) -> DataFrame:
    """Final ranks with the older formula for what was not scored."""
    return _rounded(fused(t, "legacy").select("query_label", "vec_id", "final_score", "final_rank"), "final_score")


@CATALOGUE.add(f"""WITH {FUSED_SQL}, spread AS (
  SELECT query_label, 0.4::DOUBLE * (max(semantic) - min(semantic)) AS semantic, 0.5::DOUBLE * coalesce(max(match_score) - min(match_score), 0) AS llm_match,
    0.1::DOUBLE * coalesce(max(sure) FILTER (asked) - min(sure) FILTER (asked), 0) AS confidence, max(CASE WHEN asked THEN risk ELSE 0 END) - min(CASE WHEN asked THEN risk ELSE 0 END) AS risk_penalty
  FROM fused GROUP BY 1), total AS (SELECT *, semantic + llm_match + confidence + risk_penalty AS total_spread FROM spread)
SELECT query_label, round(total_spread, 6) AS total_spread, CASE WHEN total_spread > 0 THEN round(semantic / total_spread, 6) END AS semantic_share,
  CASE WHEN total_spread > 0 THEN round(llm_match / total_spread, 6) END AS llm_match_share FROM total""")
def component_contributions(t: Tables) -> DataFrame:
    """What moves the final score of each request."""
    out = ranking.contributions(fused(t), ["query_label"]).select("query_label", "total_spread", "semantic_share", "llm_match_share")
    return _rounded(out, "total_spread", "semantic_share", "llm_match_share")


@CATALOGUE.add("""SELECT doc_id, round(least(CASE WHEN toxic = 1 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN quality = 1 THEN 0 ELSE 0.05::DOUBLE END, 1), 6) AS flat,
  round(least(CASE WHEN toxic = 1 THEN 0.35::DOUBLE * CASE WHEN quality = 1 THEN 1.0 ELSE 0.3::DOUBLE END ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN quality = 1 THEN 0 ELSE 0.05::DOUBLE END, 1), 6) AS scaled
FROM documents JOIN labels USING (doc_id)""")
def risk_penalty(t: Tables) -> DataFrame:
    """Both penalty policies on the labelled documents."""
    rows = t("documents").join(t("labels"), "doc_id")
    violated = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    level = F.when(F.col("quality") == 1, "high").otherwise("low")
    args = (violated, level, F.array().cast("array<string>"), F.col("text"))
    return rows.select("doc_id", *[F.round(decide.risk_penalty(*args, scaled=s, marks=("license",)), 6).alias(n) for n, s in (("flat", False), ("scaled", True))])


@CATALOGUE.add(f"""WITH {RESULTS_SQL} SELECT system_variant, count(*) AS judged_rows, round(avg((relevance_label >= 1)::INT), 6) AS precision, round(avg((relevance_label = 2)::INT), 6) AS strong_precision,
  round(avg(relevance_label), 6) AS mean_relevance, round(avg(constraint_violation::INT), 6) AS violation_rate FROM results WHERE rank <= 10 GROUP BY 1""")
def manual_metrics(t: Tables) -> DataFrame:
    out = evaluation.manual_metrics(results(t))
    return _rounded(out, "precision", "strong_precision", "mean_relevance", "violation_rate")


_ANCHORS_SQL = f"""{RESULTS_SQL},
anchors AS (SELECT query_label AS query_id, unnest(['L' || query_label || '-1', 'L' || ((query_label + 1) % 10)]) AS anchor FROM (SELECT DISTINCT query_label FROM merged)),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id, system_variant ORDER BY rank, title_guess) AS place FROM results),
found AS (SELECT system_variant, query_id, anchor, min(place) AS place, arg_min(rank, place) AS rank FROM places JOIN anchors USING (query_id)
  WHERE place <= 10 AND starts_with(lower(replace(title_guess, '-', '')), lower(replace(anchor, '-', ''))) GROUP BY ALL),
every AS (SELECT * FROM anchors CROSS JOIN (SELECT DISTINCT system_variant FROM results) CROSS JOIN (VALUES (1), (5), (10)) ks(k)),
cuts AS (SELECT e.*, place, rank, coalesce(place <= k, false) AS hit FROM every e LEFT JOIN found USING (system_variant, query_id, anchor))"""


def _anchored(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = results(t)
    queries = merged(t).select(F.col("query_label").alias("query_id")).distinct()
    anchors = F.array(F.concat(F.lit("L"), F.col("query_id"), F.lit("-1")), F.concat(F.lit("L"), F.pmod(F.col("query_id") + 1, F.lit(10)).cast("string")))
    return rows, queries.select("query_id", anchors.alias("anchor_titles"))


@CATALOGUE.add(f"""WITH {_ANCHORS_SQL}, one AS (SELECT system_variant, k, query_id, count(*) FILTER (hit) AS found, count(*) AS anchors, arg_min(rank, place) FILTER (hit) AS first_rank FROM cuts GROUP BY ALL)
SELECT system_variant, k, round(avg((found > 0)::INT), 6) AS hit_rate, round(sum(found) / sum(anchors), 6) AS anchor_recall, round(avg(first_rank) FILTER (k = 10 AND found > 0), 6) AS mean_first_rank FROM one GROUP BY ALL""")
def anchor_hit_recall(t: Tables) -> DataFrame:
    """Hit rate, anchor recall and mean first rank of both systems."""
    return _rounded(evaluation.anchor_metrics(*_anchored(t)), "hit_rate", "anchor_recall", "mean_first_rank")


@CATALOGUE.add(f"""WITH {_ANCHORS_SQL} SELECT system_variant, k, CASE WHEN contains(anchor, '-') THEN 'eval' ELSE 'unknown' END AS fold, count(*) FILTER (hit) AS found, count(*) AS total,
  round(avg(hit::INT), 6) AS recall FROM cuts GROUP BY ALL""")
def anchor_recall_by_fold(t: Tables) -> DataFrame:
    rows, queries = _anchored(t)
    known = queries.select(F.explode("anchor_titles").alias("anchor")).where(F.col("anchor").contains("-")).withColumn("fold", F.lit("eval"))
    return _rounded(evaluation.anchor_metrics(rows, queries, folds=known), "recall")


_RATED_SQL = """rated AS (
  SELECT doc_id, lang, quality + 1 - toxic AS a, CASE WHEN length(text) < 300 THEN 0 WHEN length(text) < 1500 THEN 1 ELSE 2 END AS b, toxic = 1 AS judge, contains(text, 'license') AS marked,
    CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, 'the', '')))::DOUBLE / 3 / length(text) * 1e5 ELSE 0 END AS d FROM documents JOIN labels USING (doc_id)),
ruled AS (SELECT *, CASE WHEN d >= 900 THEN true WHEN d <= 100 THEN false END AS rule FROM rated)"""
_KAPPA_SQL = """cells AS (SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b, count(*)::DOUBLE AS c FROM ruled WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
n AS (SELECT sum(c) AS n FROM cells), ma AS (SELECT a, sum(c) / any_value(n) AS p FROM cells, n GROUP BY a), mb AS (SELECT b, sum(c) / any_value(n) AS p FROM cells, n GROUP BY b),
k AS (SELECT any_value(n)::BIGINT AS n, 1 - (SELECT sum({w} * c / n) FROM cells, n) / (SELECT sum({w} * ma.p * mb.p) FROM ma, mb) AS kappa FROM n)"""


def rated(t: Tables) -> DataFrame:
    """Labelled documents with two graders' labels, a rule and a judge."""
    rows = t("documents").join(t("labels"), "doc_id")
    size = F.length("text")
    return rows.select(
        "doc_id", "lang", (F.col("quality") + 1 - F.col("toxic")).alias("a"), F.when(size < 300, 0).when(size < 1500, 1).otherwise(2).alias("b"),
        (F.col("toxic") == 1).alias("judge"), F.col("text").contains("license").alias("marked"),
        decide.verdict(text.density(F.col("text"), "the"), 900.0, 100.0).alias("rule"),
    )


@CATALOGUE.add(f"WITH {_RATED_SQL} SELECT a AS rater_a, b AS rater_b, count(*) AS n FROM ruled GROUP BY ALL")
def confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(rated(t), "a", "b", (0, 1, 2))


_BANDS_SQL = "CASE WHEN kappa < 0 THEN 'worse than chance' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END"


@CATALOGUE.add(f"WITH {_RATED_SQL}, {_KAPPA_SQL.format(a='a', b='b', w='abs(a - b) / 2')} SELECT n, round(kappa, 6) AS kappa, {_BANDS_SQL} AS band FROM k")
def weighted_kappa(t: Tables) -> DataFrame:
    """Agreement on three levels, by linear weights."""
    return _rounded(evaluation.kappa(rated(t), "a", "b", (0, 1, 2), weighted=True), "kappa")


@CATALOGUE.add(f"WITH {_RATED_SQL}, {_KAPPA_SQL.format(a='marked::INT', b='judge::INT', w='(a <> b)::INT')} SELECT n, round(kappa, 6) AS kappa, {_BANDS_SQL} AS band FROM k")
def unweighted_kappa(t: Tables) -> DataFrame:
    rows = rated(t).select(F.col("marked").cast("int").alias("a"), F.col("judge").cast("int").alias("b"))
    return _rounded(evaluation.kappa(rows, "a", "b", (0, 1)), "kappa")


@CATALOGUE.add(f"""WITH {_RATED_SQL}, one AS (WITH {_KAPPA_SQL.format(a='a', b='b', w='abs(a - b) / 2')} SELECT round(kappa, 4) AS relevance_kappa, {_BANDS_SQL} AS relevance_band FROM k),
two AS (WITH {_KAPPA_SQL.format(a='marked::INT', b='judge::INT', w='(a <> b)::INT')} SELECT round(kappa, 4) AS violation_kappa, {_BANDS_SQL} AS violation_band FROM k)
SELECT (SELECT count(*) FROM ruled) AS n, (SELECT round(avg((a = b)::INT), 4) FROM ruled) AS exact_agreement, (SELECT round(avg((marked = judge)::INT), 4) FROM ruled) AS violation_agreement,
  relevance_kappa, relevance_band, violation_kappa, violation_band FROM one, two""")
def agreement_report(t: Tables) -> DataFrame:
    rows = rated(t).select(F.col("a").alias("relevance_label"), F.col("b").alias("judge_relevance_label"), F.col("marked").alias("constraint_violation"), F.col("judge").alias("judge_constraint_violation"))
    return evaluation.agreement(rows)


@CATALOGUE.add(f"WITH {_RATED_SQL} SELECT doc_id, a AS relevance_label, b AS judge_relevance_label, abs(a - b) AS gap FROM ruled WHERE abs(a - b) >= 2")
def label_disagreements(t: Tables) -> DataFrame:
    rows = rated(t).select("doc_id", F.col("a").alias("relevance_label"), F.col("b").alias("judge_relevance_label"))
    return evaluation.disagreements(rows)


@CATALOGUE.add(f"""WITH {_RATED_SQL}, c AS (SELECT count(*) AS pairs, count(rule) AS decided, count(*) FILTER (rule AND judge) AS true_positive, count(*) FILTER (rule AND NOT judge) AS false_positive,
  count(*) FILTER (NOT rule AND judge) AS false_negative, count(*) FILTER (NOT rule AND NOT judge) AS true_negative FROM ruled)
SELECT *, pairs - decided AS abstained, round(CASE WHEN decided > 0 THEN (true_positive + true_negative) / decided ELSE 0 END, 6) AS agreement,
  round(CASE WHEN true_positive + false_negative > 0 THEN false_negative / (true_positive + false_negative) ELSE 0 END, 6) AS rule_miss_rate FROM c""")
def rule_judge_divergence(t: Tables) -> DataFrame:
    return _rounded(evaluation.divergence(rated(t)), "agreement", "rule_miss_rate")


@CATALOGUE.add(f"""WITH {_RATED_SQL} SELECT lang AS term, count(*) AS n, round(avg((rule = judge)::INT), 6) AS agreement, count(*) FILTER (NOT rule AND judge) AS misses, count(*) FILTER (rule AND NOT judge) AS over_fires
FROM ruled WHERE rule IS NOT NULL GROUP BY lang""")
def by_term_divergence(t: Tables) -> DataFrame:
    return _rounded(evaluation.divergence_by_term(rated(t).withColumnRenamed("lang", "term")), "agreement")


@CATALOGUE.add(f"WITH {RESULTS_SQL} SELECT DISTINCT query_id, vec_id AS novel_id FROM results WHERE NOT (vec_id % 3 = 0)")
def judging_tasks(t: Tables) -> DataFrame:
    """Pairs of both systems that no cached verdict covers."""
    cache = t("embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("novel_id"))
    rows = results(t)
    known = rows.join(cache, "novel_id", "left_semi").select("query_id", "novel_id")
    return logs.judging_tasks(rows, known)


@CATALOGUE.add(f"WITH {RESULTS_SQL} SELECT query_id, system_variant, rank::INT AS rank, vec_id AS novel_id, CASE WHEN vec_id % 3 = 0 THEN relevance_label END AS verdict FROM results")
def judged_results(t: Tables) -> DataFrame:
    """Result rows with the verdicts that exist; the others stay null."""
    rows = results(t)
    verdicts = rows.where("novel_id % 3 = 0").select("query_id", "novel_id", F.col("relevance_label").alias("verdict"))
    return logs.judged_pairs(rows.select("query_id", "system_variant", "rank", "novel_id"), verdicts)


@CATALOGUE.add("SELECT label, count(*) AS n, round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS mean_square FROM embeddings GROUP BY label")
def vector_check(t: Tables) -> DataFrame:
    """Valid vectors by label, with their mean squared length."""
    rows = retrieval.check_vectors(t("embeddings"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(retrieval.inner_product(F.col("embedding"), F.col("embedding"))), 6).alias("mean_square"))


@CATALOGUE.add("SELECT doc_id, quality FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def fold_filter(t: Tables) -> DataFrame:
    """Rows whose id has the wanted fold; ids without one are dropped."""
    named = t("documents").select("doc_id", F.when(F.col("lang") == "en", "train").otherwise("eval").alias("fold"))
    return corpus.filter_fold(t("labels").where("toxic = 0").select("doc_id", "quality"), named, "train", key="doc_id")
