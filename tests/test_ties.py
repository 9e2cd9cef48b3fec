"""Final scores that are equal but for rounding, against the queries' SQL."""

from __future__ import annotations

import pytest
from compare import differences, tables
from pyspark.sql import functions as F

from inkwell.operators import ranking
from inkwell.plans import catalogue


def test_scores_of_nine_places_tie(spark):
    data = [(1, 1, 0.5, 1), (2, 2, 0.5 + 1e-12, 1), (3, 3, 0.0, 1), (4, 4, 1.0, 1)]
    rows = spark.createDataFrame(data, "novel_id int, retrieval_rank int, best_score double, matched int")
    none = F.lit(None).cast("array<string>")
    rows = rows.withColumns({"match_score": F.lit(None).cast("double"), "confidence": F.lit(None).cast("string"), "violated": none, "flags": none})
    for policy in ("impute", "legacy"):
        found = ranking.fuse(rows, policy=policy).orderBy("final_rank").select("novel_id").collect()
        assert [r[0] for r in found] == [4, 1, 2, 3]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Vector 240 is longer than 120 by less than a score's nine places tell,
    but 120 is nearer to the other queries and so ranks first before fusion."""
    at = lambda **x: [x.get(f"e{i}", 0.0) for i in range(12)]
    others = (20, 40, 80, 100, 160, 200)
    data = [(240, at(e1=1.0, e0=1e-9**0.5)), (120, at(e2=1.0)), (1, at(e9=1.0))]
    data += [(v, at(e2=0.1, **{f"e{3 + i}": 0.9})) for i, v in enumerate(others)]
    data += [(v, at(**{f"e{3 + i}": 0.3 for i in range(6)})) for v in (301, 302, 303)]
    out = str(tmp_path_factory.mktemp("tied"))
    spark.createDataFrame([(v, x, 0) for v, x in data], "vec_id long, embedding array<float>, label int").toPandas().to_parquet(f"{out}/embeddings.parquet", index=False)
    return out


@pytest.mark.parametrize("name", ["fusion_impute", "fusion_legacy", "judged_results", "anchor_hit_recall"])
def test_ties_agree_with_sql(spark, tied, name):
    assert not differences(catalogue.queries()[name](spark, tied), catalogue.oracle_sql()[name], tables(tied))
