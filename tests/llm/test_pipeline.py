"""The five stages on a small table, each against a brute-force version of what it decides."""

from __future__ import annotations

import corpus_pipeline
import pytest

from inkwell.llm import exact, mixing, packing, quality, simhash


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf).cache()
        out.append((name, docs))
    return dict(out)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages, documents):
    for name in list(stages)[:-1]:
        assert stages[name].columns == documents.columns


def test_quality(stages, documents, spark, sf):
    scored = quality.classify(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(stages["quality"]) == ids(scored.where("p_good >= 0.5")) and len(ids(stages["quality"])) < documents.count()


def test_exact(stages):
    last = {}
    for r in stages["quality"].collect():
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", r["doc_id"]))
    assert ids(stages["exact_dedup"]) == sorted(last.values())
    assert ids(exact.label_copies(stages["quality"]).where("kept")) == sorted(last.values())


def test_near(stages):
    from test_shingles import slow_kept

    assert ids(stages["simhash_dedup"]) == slow_kept([(r["doc_id"], r["text"]) for r in stages["exact_dedup"].collect()])


def test_mixing(stages):
    times = {r["doc_id"]: r["taken"] for r in mixing.queue(stages["simhash_dedup"]).collect()}
    assert ids(stages["mixing"]) == sorted(d for d, n in times.items() for _ in range(n))


def test_packing(stages):
    want = packing.pack(stages["mixing"])
    assert stages["packing"].columns == want.columns
    assert sorted(map(str, stages["packing"].collect())) == sorted(map(str, want.collect()))
    assert stages["packing"].selectExpr("sum(length)").first()[0] == sum(r["doc_tokens"] for r in stages["packing"].where("start = 0").collect())


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"].count()


def test_stages_on_hard_rows(spark, sf, hard, none):
    """These few rows have too few labels to reject any; what each later stage keeps is asserted row by row."""
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, sf).count() == 0
    steps = dict(corpus_pipeline.STAGES)
    said = lambda df: sorted(((r["doc_id"], (r["text"] or "")[:30]) for r in df.select("doc_id", "text").collect()), key=str)
    assert said(steps["quality"](spark, hard, sf)) == said(hard)
    once = steps["exact_dedup"](spark, hard, sf)
    same, long = "one two three four five", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 "
    rest = [(4, " \t\n\x0b "), (5, long), (7, "Größe\xa0\u3000ok 𝔘nicode \u2028 x"), (8, "<|im_start|> </s> [INST] \x00 en"[:30]), (None, same + " six"), (-5, "one  " + same[4:])]
    assert said(once) == sorted([*[(d, t[:30]) for d, t in rest], (6, same), (3, "")], key=str)
    near = steps["simhash_dedup"](spark, once, sf)
    # (6, ...) is (-5, ...) but for white space, and (4, ...) has no words like (3, "").
    assert said(near) == sorted([(-5, "one  " + same[4:]), (3, ""), *[(d, t[:30]) for d, t in rest if d not in (-5, 4)]], key=str)
    mixed = steps["mixing"](spark, near, sf)
    times = {r["doc_id"]: r["taken"] for r in mixing.queue(near).collect()}
    assert ids(mixed.where("doc_id IS NOT NULL")) == sorted(d for d, n in times.items() if d is not None for _ in range(n))
    packed = steps["packing"](spark, mixed, sf)
    assert packed.where("start = 0").count() == mixed.count()
