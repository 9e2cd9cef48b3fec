from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import quality

LARGER = "/root/testdata/sf0.1"


def test_views():
    assert not quality.content_view(None).any() and not quality.content_view("ab").any()
    view = quality.content_view("some text, some text")
    assert np.isclose((view**2).sum(), 1)
    assert quality.metadata_view(None, None, None).shape == (quality.LAYOUT,)


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1000)
    views = [np.column_stack([y + rng.normal(0, s, 1000), rng.normal(0, 1, (1000, 3))]).astype("f4") for s in (0.6, 0.9)]
    seen = slice(0, 60)
    with_pool = quality.co_train([v[seen] for v in views], y[seen].astype(float), [v[60:500] for v in views], sure=0.8)
    score, one, two = with_pool.score(*[v[500:] for v in views])
    right = [((s >= 0.5) == y[500:]).mean() for s in (score, one, two)]
    assert right[0] >= max(right[1:]) - 0.02 and right[0] > 0.78
    assert quality.co_train([v[seen] for v in views], np.ones(60), [v[60:] for v in views]) is None


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    scored = quality.classify(docs, labels.where(~held)).join(labels.where(held), "doc_id").select("p_good", "quality", "kept").toPandas()
    good = scored[scored.quality == 1]
    bad = scored[scored.quality == 0]
    order = scored.p_good.rank()
    area = (order[good.index].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert area > 0.97
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.2


def test_scores_do_not_depend_on_partitions(documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one, two = (quality.classify(d, labels).orderBy("doc_id").select("p_good").toPandas() for d in (documents, documents.repartition(5)))
    assert np.allclose(one, two, atol=1e-6)


def test_hard_rows(hard, clashing, none, spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in (1, 2, 3, 4, 5, 6, 7, 8, -5)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(clashing, labels)
    assert found.count() == hard.count() and found.where("kept IS NULL OR p_good IS NULL").count() == 0
    assert set(clashing.columns) <= {*found.columns, "__s"}
    assert quality.classify(none, labels).count() == 0
    unknown = quality.classify(hard, labels.where("quality = 1"))
    assert unknown.where("kept AND p_good IS NULL").count() == hard.count()
    assert quality.classify(hard.drop("source", "lang"), labels).count() == hard.count()


def test_samples_are_bounded_by_their_parameters(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    repeated = documents.unionByName(documents)
    assert quality.train(repeated, labels, labelled=40, pool=30) is not None
    with pytest.raises(TypeError):
        quality.train(documents, labels, unknown=1)


def test_no_labelled_document_is_in_the_pool(spark, documents, sf, monkeypatch):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(quality, "co_train", lambda x, y, pool, **options: (len(y), len(pool[0])))
    free = documents.join(labels.where("quality IS NOT NULL"), "doc_id", "left_anti").count()
    seen, pool = quality.train(documents, labels, labelled=40)
    assert seen == 40 and pool == free < documents.count()
