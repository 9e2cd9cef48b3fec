"""Samples, balance, hold-outs, exports and rewards over the search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decide
from ..operators import datasets
from .ranking_queries import KNN_SQL, RESULTS_SQL, knn, results
from .registry import Catalogue, Tables

CATALOGUE = Catalogue()
SEED = 20260811
_EPISODES_SQL = f"""{KNN_SQL},
episodes AS (
  SELECT query_id, vec_id AS novel_id, (rank - 1)::INT AS pool_rank, CASE label % 3 WHEN 0 THEN true WHEN 1 THEN false END AS rule_verdict, score AS ref_score FROM ranked WHERE rank <= 40)"""


def _draw_sql(*keys: str, seed: str = str(SEED)) -> str:
    return f"sha256(concat_ws(':', '{seed}', {', '.join(keys)}))"


def episodes(t: Tables) -> DataFrame:
    """The forty best candidates of every query with the rule's verdict."""
    third = F.col("label") % 3
    return knn(t, 40).select(
        "query_id", F.col("vec_id").alias("novel_id"), (F.col("rank") - 1).alias("pool_rank"),
        F.when(third == 0, True).when(third == 1, False).alias("rule_verdict"), F.col("score").alias("ref_score"),
    )


@CATALOGUE.add(f"""WITH {RESULTS_SQL},
one AS (SELECT query_id, vec_id AS novel_id, system_variant, rank, CASE WHEN rank <= 3 THEN '1-3' WHEN rank <= 10 THEN '4-10' ELSE 'other' END AS rank_band, {_draw_sql('query_id', 'vec_id')} AS draw
  FROM results QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY system_variant, rank) = 1),
strata AS (SELECT greatest(1, 60 // count(*)) AS each FROM (SELECT DISTINCT query_id, rank_band FROM one)),
marked AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank_band ORDER BY draw, novel_id) <= each AS chosen FROM one, strata)
SELECT query_id, novel_id, system_variant, rank::INT AS rank, rank_band FROM marked
ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, CASE WHEN chosen THEN query_id END, CASE WHEN chosen THEN rank_band END, draw, novel_id LIMIT 60""")
def stratified_sample(t: Tables) -> DataFrame:
    """An annotation sheet of 60 rows, even over requests and rank bands."""
    return datasets.stratified_sample(results(t), 60, SEED).select("query_id", "novel_id", "system_variant", "rank", "rank_band")


@CATALOGUE.add(f"""WITH {_EPISODES_SQL}, drawn AS (SELECT *, row_number() OVER (PARTITION BY query_id, pool_rank < 5 ORDER BY {_draw_sql('query_id', 'novel_id')}, novel_id) AS n FROM episodes)
SELECT query_id, novel_id, pool_rank FROM drawn WHERE pool_rank < 5 OR n <= 5""")
def head_tail_sample(t: Tables) -> DataFrame:
    """The head of every pool and a sample of its tail."""
    return datasets.head_and_tail(episodes(t), 5, 5, SEED).select("query_id", "novel_id", "pool_rank")


@CATALOGUE.add(f"""WITH {_EPISODES_SQL}, decided AS (SELECT *, {_draw_sql('query_id', 'novel_id')} AS draw FROM episodes WHERE rule_verdict IS NOT NULL),
sides AS (SELECT *, row_number() OVER (PARTITION BY query_id, rule_verdict ORDER BY (pool_rank >= 20)::INT, draw, novel_id) AS n,
  least(count(*) FILTER (rule_verdict) OVER w, count(*) FILTER (NOT rule_verdict) OVER w) AS least FROM decided WINDOW w AS (PARTITION BY query_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_draw_sql('query_id', 'novel_id', seed=f'{SEED}:cap')}, novel_id) AS m FROM sides WHERE n <= least)
SELECT query_id, novel_id, pool_rank, rule_verdict FROM kept WHERE m <= 4""")
def class_balance(t: Tables) -> DataFrame:
    """As many violating as clean candidates of every query, four at most."""
    return datasets.balanced(episodes(t), SEED).select("query_id", "novel_id", "pool_rank", "rule_verdict")


@CATALOGUE.add(f"""WITH {_EPISODES_SQL}, q AS (SELECT query_id, row_number() OVER (ORDER BY {_draw_sql('query_id')}, query_id) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT query_id FROM episodes))
SELECT query_id, novel_id, CASE WHEN n <= greatest(1, floor(total * 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM episodes JOIN q USING (query_id)""")
def query_holdout(t: Tables) -> DataFrame:
    """Whole queries held out for validation."""
    return datasets.hold_out(episodes(t), 0.2, SEED).select("query_id", "novel_id", "split")


_ANCHOR_SQL = f"""{_EPISODES_SQL}, anchored AS (SELECT *, CASE WHEN rule_verdict THEN avg(ref_score) FILTER (NOT rule_verdict) OVER w WHEN NOT rule_verdict THEN avg(ref_score) FILTER (rule_verdict) OVER w END AS partner_anchor
  FROM episodes WINDOW w AS (PARTITION BY query_id))"""


@CATALOGUE.add(f"WITH {_ANCHOR_SQL} SELECT query_id, novel_id, rule_verdict, round(partner_anchor, 6) AS partner_anchor FROM anchored")
def partner_anchor(t: Tables) -> DataFrame:
    """The mean score of the opposite verdict in each query."""
    out = datasets.partner_anchor(episodes(t))
    return out.select("query_id", "novel_id", "rule_verdict", F.round("partner_anchor", 6).alias("partner_anchor"))


@CATALOGUE.add(f"""WITH {_ANCHOR_SQL} SELECT 'pool' AS data_source, 'user' AS role, 'Rate ' || novel_id || ' for ' || query_id AS content, 'rerank' AS ability,
  coalesce(rule_verdict::VARCHAR, 'none') AS ground_truth, pool_rank, CASE WHEN rule_verdict IS NULL THEN '' ELSE 'term' END AS terms FROM anchored""")
def export_struct(t: Tables) -> DataFrame:
    """Nested training rows, flattened again."""
    rows = datasets.partner_anchor(episodes(t)).withColumns(
        {
            "prompt": F.concat(F.lit("Rate "), F.col("novel_id"), F.lit(" for "), F.col("query_id")), "query": F.col("query_id").cast("string"),
            "constraint_terms": F.when(F.col("rule_verdict").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("term"))),
        }
    )
    out = datasets.exported(rows, "pool")
    first = F.get("prompt", F.lit(0))
    return out.select(
        "data_source", first["role"].alias("role"), first["content"].alias("content"), "ability", F.col("reward_model.ground_truth").alias("ground_truth"),
        "extra_info.pool_rank", F.array_join("extra_info.constraint_terms", ",").alias("terms"),
    )


_REWARD_SQL = f"""{_ANCHOR_SQL}, claimed AS (SELECT *, novel_id % 2 = 0 AS claims FROM anchored),
paid AS (SELECT *, CASE WHEN rule_verdict IS NULL THEN NULL WHEN claims = rule_verdict THEN 1.0::DOUBLE WHEN claims THEN 0.4::DOUBLE ELSE 0 END AS r_constraint,
  CASE WHEN rule_verdict IS NOT NULL AND partner_anchor IS NOT NULL THEN greatest(0, least(0.5::DOUBLE + CASE WHEN rule_verdict THEN partner_anchor - ref_score ELSE ref_score - partner_anchor END / 0.6::DOUBLE, 1)) END AS r_score FROM claimed),
total AS (SELECT *, coalesce(r_constraint * 0.58::DOUBLE, 0) + CASE WHEN r_constraint IS NULL THEN 0 ELSE coalesce(r_score * 0.4::DOUBLE, 0) END + 0.02::DOUBLE AS reward FROM paid)"""


def _paid(t: Tables) -> DataFrame:
    rows = datasets.partner_anchor(episodes(t))
    rows = rows.withColumn("r_constraint", decide.constraint_reward(F.col("novel_id") % 2 == 0, F.col("rule_verdict")))
    rows = rows.withColumn("r_score", decide.pairwise_reward(F.col("ref_score"), F.col("rule_verdict"), F.col("partner_anchor")))
    return rows.withColumn("reward", decide.total_reward(F.lit(True), F.col("r_constraint"), F.col("r_score"), F.lit(1.0)))


@CATALOGUE.add(f"WITH {_REWARD_SQL} SELECT query_id, novel_id, r_constraint FROM total")
def constraint_reward(t: Tables) -> DataFrame:
    return _paid(t).select("query_id", "novel_id", "r_constraint")


@CATALOGUE.add(f"WITH {_REWARD_SQL} SELECT query_id, novel_id, round(r_score, 6) AS r_score, round(reward, 6) AS reward FROM total")
def pairwise_reward(t: Tables) -> DataFrame:
    """How far scores lie on their side of the partners', and whole rewards."""
    return _paid(t).select("query_id", "novel_id", F.round("r_score", 6).alias("r_score"), F.round("reward", 6).alias("reward"))


@CATALOGUE.add(f"""WITH {_REWARD_SQL} SELECT query_id, novel_id, round(CASE WHEN var_pop(reward) OVER w <= 1e-12 THEN 0 ELSE (reward - avg(reward) OVER w) / stddev_pop(reward) OVER w END, 6) AS advantage
FROM total WINDOW w AS (PARTITION BY query_id)""")
def group_advantage(t: Tables) -> DataFrame:
    """Rewards in standard deviations from their query's mean."""
    return datasets.advantages(_paid(t), group="query_id").select("query_id", "novel_id", F.round("advantage", 6).alias("advantage"))


@CATALOGUE.add("""WITH r AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS total FROM conversations WHERE text IS NOT NULL)
SELECT min(n) FILTER (i = total // 2)::INT AS median, min(n) FILTER (i = floor(0.95::DOUBLE * total))::INT AS p95, max(n)::INT AS max FROM r""")
def length_stats(t: Tables) -> DataFrame:
    """Lengths of the conversations' turns."""
    return datasets.length_stats(t("conversations").select(F.length("text").alias("n")), "n")


@CATALOGUE.add(f"SELECT doc_id FROM documents ORDER BY {_draw_sql('doc_id')}, doc_id LIMIT 100")
def seeded_sample(t: Tables) -> DataFrame:
    """A hundred documents without replacement."""
    return datasets.sample(t("documents").select("doc_id"), 100, SEED, "doc_id")
