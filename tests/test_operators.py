from __future__ import annotations

import json

import pytest
from compare import rows
from pyspark.sql import functions as F

from inkwell.functions import decide
from inkwell.operators import corpus, datasets, evaluation, logs, preferences, profiles, ranking, retrieval


def test_exact_and_near_duplicates(spark):
    data = [
        ("a", "p1", "h1", "T", "A", 20000), ("b", "p2", "h1", "T", "A", 20000), ("c", "p3", "h2", " T", "A ", 19900), ("d", "p4", "h3", "T", "B", 20000),
        ("e", "p5", "", "T", "A", 0), ("f", "p6", "h4", "T", "A", 15000), ("g", "p7", None, "T", None, 20000),
    ]
    df = spark.createDataFrame(data, "novel_id string, path string, sha string, title string, author string, n int")
    exact = corpus.exact_duplicates(df, key="novel_id", content="sha", order="path")
    near = corpus.near_duplicates(exact, key="novel_id", title="title", author="author", length="n", order="path")
    found = {r["novel_id"]: (r["is_duplicate"], r["is_near"], r["duplicate_of"]) for r in near.collect()}
    assert found["b"] == (True, False, "a")
    assert found["c"] == (True, True, "a")
    assert all(found[x] == (False, False, None) for x in "adefg")
    report = corpus.duplicate_report(near, title="title", status=None).first()
    assert (report["exact_duplicates"], report["near_duplicates"], report["originals"]) == (1, 1, 1)


def test_splits_check_columns_and_keep_folds_as_the_corpus_grows(spark):
    with pytest.raises(ValueError, match="content_sha256"):
        corpus.splits(spark.range(1).select(F.lit("a").alias("novel_id")))

    def folds(n):
        df = spark.range(n).select(F.concat(F.lit("n"), "id").alias("novel_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"),
                                   F.when(F.col("id") == 5, "failed").otherwise("ok").alias("read_status"), (F.col("id") == 6).alias("is_duplicate"))
        return {r["novel_id"]: r["fold"] for r in corpus.splits(df).collect()}

    small, large = folds(600), folds(2000)
    assert all(large[k] == v for k, v in small.items())
    assert "n5" not in large and "n6" not in large
    assert 0.15 < sum(v == "eval" for v in large.values()) / len(large) < 0.25


def test_quantiles_are_exact_with_heavy_ties(spark):
    values = [0.0] * 500 + [float(i) for i in range(1, 400)] + [-3.5, 1e9]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)], "g string, v double").repartition(5)
    found = {r["g"]: r for r in corpus.exact_quantiles(df, "v", "g", (0.0, 0.25, 0.5, 0.77, 0.9, 1.0)).collect()}
    import numpy as np

    assert found["a"]["quantiles"] == pytest.approx(np.quantile(values, (0.0, 0.25, 0.5, 0.77, 0.9, 1.0)).tolist())
    assert found["b"]["quantiles"] == [2.0] * 6


def test_chapters_and_profiles(spark):
    body = "很长的正文。" * 60
    text = "前言丢弃\n内容简介：\n这是简介。\n" + "\n".join(f"第{n}章 标题{n}\n{body}" for n in "一二三四五")
    rows_of = lambda text: spark.createDataFrame([(text,)], "t string")
    split = lambda text: [tuple(c) for c in rows_of(text).select(profiles.chapters(F.col("t")).alias("c")).first()["c"]]
    assert [c[1] for c in split(text)] == [f"第{n}章 标题{n}" for n in "一二三四五"]
    assert {c[2] for c in split(text)} == {body} and [c[0] for c in split(text)] == [1, 2, 3, 4, 5]
    assert split("没有标题") == [(1, "全文", "没有标题")] and split(None) == split(" \n") == []
    blurb = lambda text: rows_of(text).select(profiles.blurb(F.col("t")).alias("b")).first()["b"]
    assert blurb(text) == "这是简介。" and blurb("没有") == ""
    df = spark.createDataFrame([("n", "书名", None, text)], "novel_id string, title_guess string, author_guess string, text string")
    made = profiles.build_profiles(df).first()
    assert made["profile_text"].startswith("标题：书名\n长度") and "内容简介：\n这是简介。" in made["profile_text"]
    assert made["chapter_excerpt_count"] == 4 and made["estimated_chapter_count"] == 5 and len(made["profile_text"]) <= 8000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 11, 23, 100, 1234])
def test_sampled_positions(spark, n):
    found = spark.range(1).select(profiles.sampled_positions(F.lit(n)).alias("p")).first()["p"]
    usable = max(1, int(n * 0.95)) if n else 0
    assert found == sorted(set(found)) and all(p < usable for p in found)
    assert len(found) == min(10, usable) and found[:4] == list(range(min(4, usable)))
    if usable > 10:
        assert found[-1] == usable - 1 and max(b - a for a, b in zip(found[4:], found[5:])) - min(b - a for a, b in zip(found[4:], found[5:])) <= 1


def test_evidence_avoids_the_profile(spark):
    df = spark.range(40).select(profiles.evidence_positions(F.col("id").cast("string"), F.lit(60)).alias("e"), profiles.sampled_positions(F.lit(60)).alias("s"))
    for r in df.collect():
        assert len(r["e"]) == 6 and not set(r["e"]) & set(r["s"])
    few = spark.range(5).select(profiles.evidence_positions(F.lit("k"), F.col("id").cast("int")).alias("e")).collect()
    assert [r["e"] for r in few][:3] == [[], [], []] and all(r["e"] for r in few[3:])
    assert set(profiles.evidence_starts()).isdisjoint(profiles.window_starts(10)) and len(profiles.evidence_starts()) == 6
    told = spark.createDataFrame([("k", "正文。" * 2000), ("l", ""), ("m", None)], "k string, t string").select(profiles.evidence_with()("k", "t").alias("e")).collect()
    assert 0 < len(told[0]["e"]) <= 6 * 710 and told[1]["e"] == told[2]["e"] == ""


def test_fractions_keep_their_distance(spark):
    df = spark.range(40).select(profiles.apart_fractions(F.col("id").cast("string"), 4).alias("f"))
    found = [tuple(r["f"]) for r in df.collect()]
    assert len(set(found)) == 40 and all(abs(x - a) >= 0.08 - 1e-9 or x == 0.97 for f in found for x in f for a in (0.0, 0.5, 1.0))
    cut = spark.range(1).select(profiles.window_at(F.lit("abc"), F.lit(0.9), 10).alias("a"), profiles.window_at(F.lit("abcdef"), F.lit(0.5), 2).alias("b")).first()
    assert (cut["a"], cut["b"]) == ("abc", "de")
    with pytest.raises(ValueError, match="positive"):
        profiles.apart_fractions(F.lit("x"), 0)


def test_search_refuses_ragged_vectors(spark):
    corpus_df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])], "vec_id long, embedding array<float>")
    for query in ([1.0, 0.0, 0.0, 0.0], [1.0, 0.0]):
        with pytest.raises(Exception, match="vectors of"):
            retrieval.search(spark.createDataFrame([(7, query)], "query_id long, embedding array<float>"), corpus_df, 2).collect()
    with pytest.raises(ValueError, match="differ in size"):
        retrieval.search(spark.createDataFrame([(7, [1.0]), (8, [1.0, 2.0])], "query_id long, embedding array<float>"), corpus_df, 2)


def test_length_stats_take_elements(spark):
    for n in (1, 2, 3, 4, 19, 20, 40):
        got = datasets.length_stats(spark.range(n).select((F.col("id") * 2).alias("x")), "x").first()
        assert tuple(got) == (2 * (n // 2), 2 * int(0.95 * n), 2 * (n - 1))


def test_search_small_vectors(spark):
    corpus_df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.8, 0.6]), (3, None)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"], r["rank"]) for r in retrieval.search(queries, corpus_df, 2).orderBy("rank").collect()] == [(0, 1.0, 1), (2, pytest.approx(0.8), 2)]
    assert retrieval.search(queries.where("query_id = 8"), corpus_df, 2).count() == 0
    assert retrieval.search(queries, corpus_df.where("vec_id = 9"), 2).count() == 0
    with pytest.raises(ValueError, match="positive"):
        retrieval.search(queries, corpus_df, 0)
    with pytest.raises(Exception, match="finite"):
        retrieval.check_vectors(corpus_df).collect()


def test_search_in_blocks_agrees(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    assert rows(retrieval.search(q, df, 3)) == rows(retrieval.search(q, df, 3, block=7))


HITS = "seq int, source string, weight double, rank int, score double, novel_id string"


def test_merge_takes_the_rank_of_the_best_score(spark):
    hits = spark.createDataFrame([(0, "raw", 1.0, 2, 0.5, "a"), (1, "llm", 0.9, 4, 0.7, "a"), (2, "llm", 0.8, 1, 0.7, "a"), (0, "raw", 1.0, 1, 0.6, "b"), (0, "raw", 1.0, 3, 0.1, "")], HITS)
    found = {r["novel_id"]: r for r in retrieval.merge(hits, total=3).collect()}
    a = found["a"]
    assert set(found) == {"a", "b"}
    assert (a["best_score"], a["best_rank"], a["matched"], a["sources"]) == (0.7, 4, 3, ["raw", "llm"])
    assert a["retrieval_score"] == pytest.approx(0.7 * 0.7 + 0.2 + 0.1) and a["retrieval_rank"] == 1
    assert retrieval.merge(hits, total=3, k=1).count() == 1


def test_expansion_keeps_the_raw_query_first():
    answer = json.dumps({"expanded_queries": [{"text": "变体"}, {"text": "凡人流"}]})
    found = retrieval.expand("凡人流", ["仙侠"], ["系统"], answer)
    assert [(q["text"], q["source"]) for q in found] == [("凡人流", "raw"), ("修仙 灵根 法宝 丹药 金丹 元婴 飞升 宗门 无系统 无面板 无任务奖励", "domain_hints"), ("变体", "llm")]
    assert [q["source"] for q in retrieval.expand("x", answer="broken")] == ["raw"]


def candidates(spark, n=12):
    data = [(i, f"n{i}", 1.0 - i / 20, ((i * 7) % n) / n, (i * 5) % n + 1, i + 1, 1) for i in range(n)]
    return spark.createDataFrame(data, "seq int, novel_id string, retrieval_score double, best_score double, best_rank int, retrieval_rank int, matched int")


def test_selection(spark):
    found = {r["novel_id"]: r for r in ranking.select_for_scoring(candidates(spark), 5).collect()}
    assert len(found) == 5
    assert {"n0", "n1"} <= set(found)  # two by retrieval score
    assert "retrieval_score_top" in found["n0"]["reasons"]
    forced = ranking.select_for_scoring(candidates(spark), 5, forced=F.col("novel_id") == "n11").orderBy("place").collect()
    if "n11" not in found:
        assert forced[-1]["novel_id"] == "n11" and forced[-1]["reasons"] == ["debug_target_forced"] and len(forced) == 5
    assert ranking.select_for_scoring(candidates(spark, 3), 10).count() == 3


def test_fusion_policies(spark):
    base = candidates(spark, 3).withColumns({"match_score": F.when(F.col("seq") == 0, 0.9), "confidence": F.when(F.col("seq") == 0, "high"),
                                             "violated": F.array().cast("array<string>"), "flags": F.array().cast("array<string>")})
    imputed = {r["novel_id"]: r for r in ranking.fuse(base).collect()}
    assert imputed["n1"]["final_score"] == pytest.approx(0.4 * imputed["n1"]["semantic"] + 0.5 * 0.9 + 0.1)
    legacy = {r["novel_id"]: r for r in ranking.fuse(base, policy="legacy").collect()}
    assert legacy["n1"]["final_score"] == pytest.approx(0.35 * legacy["n1"]["semantic"] + 0.05 / 5)
    none = ranking.fuse(base.withColumn("match_score", F.lit(None).cast("double"))).first()
    assert none["imputed_match"] == 0.5 and none["imputed_confidence"] == 0.3
    with pytest.raises(ValueError, match="policy"):
        ranking.fuse(base, policy="other")


def test_a_constant_pool_is_all_ones(spark):
    df = candidates(spark, 3).withColumn("best_score", F.lit(0.4))
    assert {r["s"] for r in df.select(ranking.normalized(F.col("best_score")).alias("s")).collect()} == {1.0}


def test_scoring_asks_only_what_the_cache_lacks(spark):
    pending = spark.createDataFrame([("a", "k1", "p1"), ("b", "k2", "p2"), ("c", "k3", "die")], "novel_id string, cache_key string, prompt string")
    cache = spark.createDataFrame([("k1", 1, "old"), ("k1", 2, '{"llm_match_score": 0.2}')], "cache_key string, seq long, response string")

    def load():
        def answer(prompt):
            if prompt == "die":
                raise OSError
            return '{"llm_match_score": 0.8, "confidence": "high"}'

        return answer

    scored = ranking.score(pending, cache, load)
    found = {r["novel_id"]: (r["provider"], r["match_score"], r["confidence"]) for r in ranking.with_matches(scored).collect()}
    assert found == {"a": ("cache", 0.2, "low"), "b": ("llm", 0.8, "high"), "c": ("rule_fallback", 0.0, "low")}
    assert [r["cache_key"] for r in ranking.new_answers(scored, F.lit(3)).collect()] == ["k2"]


def test_preferences(spark):
    parse = lambda q: spark.range(1).select(preferences.parse(F.lit(q)).alias("p")).first()["p"]
    found = parse("理性主角，不要系统 避免 后宫、慢热 慢热")
    assert found["positive"] == ["理性", "主角", "慢热"] and found["negative"] == ["系统", "后宫"]
    assert parse("")["positive"] == []


def test_contradictions_and_leaks(spark):
    data = [("q1", "不要系统的修仙", ["修仙"], ["系统"]), ("q2", "系统流 不要系统", [], ["系统"]), ("q3", "修仙", ["系统"], ["系统"])]
    df = spark.createDataFrame(data, "query_id string, query string, wanted array<string>, unwanted array<string>")
    found = rows(df.select("query_id", preferences.self_contradictory(F.col("query"), F.col("wanted"), F.col("unwanted")).alias("x")), "query_id")
    assert [x for _, x in found] == [False, True, True]
    queries = spark.createDataFrame([("a", "修仙 慢热 不要系统", ["系统"]), ("b", "修仙 不要系统", ["系统"])], "query_id string, query string, unwanted array<string>")
    held = spark.createDataFrame([("r", "修仙 慢热 凡人流 不要后宫", ["后宫"])], "ref string, query string, unwanted array<string>")
    assert rows(preferences.leaking(queries, held)) == [("a",)]


def test_greedy_deduplication_keeps_the_first(spark):
    data = [("a", 1, "修仙 慢热 系统", []), ("b", 2, "修仙 慢热 系统 重生", []), ("c", 3, "都市 高武 直播", []), ("d", 4, "末世 囤货 异能", [])]
    df = spark.createDataFrame(data, "query_id string, seq int, query string, unwanted array<string>")
    held = spark.createDataFrame([("r", "末世 囤货 异能", [])], "ref string, query string, unwanted array<string>")
    assert [x for *_, x in rows(preferences.deduplicate(df, held).select("seq", "outcome"), "seq")] == ["kept", "duplicate", "kept", "duplicate"]


def test_overlap_finds_all_pairs_of_brute_force(spark):
    import random

    rng = random.Random(5)
    a = [(i, sorted(rng.sample("abcdefghij", rng.randint(0, 6)))) for i in range(60)]
    b = [(i, sorted(rng.sample("abcdefghij", rng.randint(0, 6)))) for i in range(40)]
    left = spark.createDataFrame(a, "k int, tokens array<string>")
    right = spark.createDataFrame(b, "ref int, tokens array<string>")
    for cut, least in ((0.8, 1), (0.5, 2), (1.0, 1)):
        want = sorted({k for k, x in a for _, y in b if min(len(x), len(y)) >= least and len({*x} & {*y}) / min(len(x), len(y)) >= cut})
        assert [r[0] for r in rows(preferences.overlapping(left, right, "tokens", key="k", threshold=cut, least=least), "k")] == want


def test_relabel_and_alignment(spark):
    data = [("a", ["系统"], True, True, True), ("b", ["系统"], True, None, True), ("c", ["后宫"], False, None, True)]
    df = spark.createDataFrame(data, "id string, unwanted array<string>, constraint_checkable boolean, rule_verdict boolean, seed_satisfies_constraint boolean")
    assert rows(preferences.relabel(df).select("id", "seed_satisfies_constraint"), "id") == [("a", False), ("c", True)]
    out = spark.range(1).select(preferences.aligned(F.array(F.lit("可能有系统"), F.lit("短")), F.lit("没有系统"), F.array(F.lit("修仙")), F.array(F.lit("系统")), F.lit(True)).alias("x")).first()["x"]
    assert out["violated"] == ["系统"] and out["flags"] == ["短"] and "系统" in out["reason"]


def test_kappa_cases(spark):
    pairs = lambda *x: spark.createDataFrame([*x], "a int, b int")
    k = lambda df, **o: evaluation.kappa(df, "a", "b", (0, 1, 2), **o).first()["kappa"]
    assert k(pairs((0, 0), (1, 1), (2, 2))) == 1
    near, far = pairs((0, 1), (1, 1), (2, 2), (0, 0)), pairs((0, 2), (1, 1), (2, 2), (0, 0))
    assert k(near, weighted=True) > k(far, weighted=True)
    assert evaluation.kappa(pairs((1, 1), (1, 1)), "a", "b").first()["kappa"] == 1
    assert evaluation.kappa(pairs((1, 1)).where("a = 9"), "a", "b").first()["kappa"] is None
    with pytest.raises(Exception, match="unknown label"):
        evaluation.confusion(pairs((0, 7)), "a", "b", (0, 1, 2)).collect()


def test_anchor_metrics(spark):
    queries = spark.createDataFrame([("q1", ["凡人", "仙逆"]), ("q2", ["诡秘"]), ("q3", [])], "query_id string, anchor_titles array<string>")
    found = spark.createDataFrame([("q1", "s", 3, "《凡人修仙传》"), ("q1", "s", 1, "别的凡人"), ("q2", "s", 1, "其他")], "query_id string, system_variant string, rank int, title_guess string")
    one = {r["k"]: r for r in evaluation.anchor_metrics(found, queries, (1, 5)).collect()}
    assert (one[5]["hit_rate"], one[5]["anchor_recall"], one[5]["mean_first_rank"]) == (0.5, pytest.approx(1 / 3), 3.0)
    assert one[1]["hit_rate"] == 0
    none = evaluation.anchor_metrics(found, queries.where("query_id = 'q3'"), (1, 5)).collect()
    assert [(r["hit_rate"], r["anchor_recall"], r["mean_first_rank"]) for r in none] == [(0.0, 0.0, None)] * 2


def test_logs(spark):
    log = spark.createDataFrame([("q", "n", 0, 1), ("q", "n", 2, 2), ("q", "m", 1, 3)], "query_id string, novel_id string, relevance_label int, seq long")
    sheet = spark.createDataFrame([("q", "n", 0), ("q", "x", 1), ("q", "m", 2)], "query_id string, novel_id string, position int")
    assert rows(logs.filled(sheet, log).select("position", "relevance_label"), "position") == [(0, 2), (1, None), (2, 1)]
    assert [r["novel_id"] for r in logs.next_unlabelled(sheet, log, 1).collect()] == ["x"]
    assert logs.next_unlabelled(sheet.where("novel_id <> 'x'"), log, 0).count() == 0
    spent = logs.within_budget(sheet, F.lit(1.0), 2.0, "position")
    assert [r["skipped"] for r in spent.orderBy("position").collect()] == [False, False, True]
    assert logs.affordable(sheet, 0.5, 1.0).first()["affordable"] is False


def test_balance_and_anchor(spark):
    data = [("q", f"n{i}", i, v) for i, v in enumerate([True, True, True, False, None, False])] + [("z", "n0", 0, True)]
    df = spark.createDataFrame(data, "query_id string, novel_id string, pool_rank int, rule_verdict boolean")
    kept = datasets.balanced(df, 1, most=None).collect()
    assert sum(r["rule_verdict"] for r in kept) == 2 == len(kept) - 2 and not [r for r in kept if r["query_id"] == "z"]
    scored = df.withColumn("ref_score", F.lit(0.5))
    found = {(r["query_id"], r["novel_id"]): r["partner_anchor"] for r in datasets.partner_anchor(scored).collect()}
    assert found["z", "n0"] is None and found["q", "n4"] is None and found["q", "n0"] == 0.5


def test_rewards_of_outputs(spark):
    good = {"llm_match_score": 0.9, "confidence": "high", "matched_preferences": [], "violated_preferences": ["有系统"], "risk_flags": [], "reason": ""}
    data = [(1, json.dumps(good), ["系统"], True, 0.9), (2, json.dumps(good) + " more", ["系统"], False, None), (3, "bad", ["系统"], True, 0.5), (4, json.dumps(good), ["系统"], None, 0.5)]
    df = spark.createDataFrame(data, "i int, response string, constraint_terms array<string>, rule_verdict boolean, partner_anchor double")
    found = {r["i"]: r for r in datasets.rewards(df).collect()}
    assert found[1]["reward"] == pytest.approx(0.58 + 0.4 * 0.5 + 0.02)
    assert found[2]["reward"] == pytest.approx(0.58 * 0.4)
    assert found[3]["reward"] == 0.0 and not found[3]["format_ok"]
    assert found[4]["r_constraint"] is None and found[4]["reward"] == pytest.approx(0.02)
    told = df.withColumn("finish", F.when(F.col("i") == 1, "length").when(F.col("i") == 2, "stop"))
    ends = {r["i"]: r["r_terminate"] for r in datasets.rewards(told, finish="finish").collect()}
    assert ends == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}
    flat = datasets.score_fields(datasets.rewards(df)).collect()
    assert all(r["r_constraint"] is not None for r in flat)


def test_advantages_and_training_pairs(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0), ("h", 2.0)], "group_id string, reward double")
    assert sorted(r["advantage"] for r in datasets.advantages(df).collect()) == [-1.0, 0.0, 0.0, 1.0]
    pairs = spark.createDataFrame([("ab", "c"), ("a" * 50, "c")], "prompt string, target string")
    found = datasets.encoded_pairs(pairs, lambda: lambda s: [ord(c) for c in s], most=10, end=0).collect()
    assert len(found) == 1 and found[0]["input_ids"] == [97, 98, 99, 0] and found[0]["labels"] == [-100, -100, 99, 0]
    assert spark.range(1).select(datasets.padded(F.array(F.lit(1)), 3, 0).alias("p")).first()["p"] == [1, 0, 0]


def test_hold_out_keeps_groups_whole(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("query_id"), "id")
    split = datasets.hold_out(df, 0.2, 3)
    assert split.groupBy("query_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert split.where("split = 'val'").select("query_id").distinct().count() == 2


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], "query_id string, novel_id string, pool_rank int, rule_verdict boolean, ref_score double")
    for df in (datasets.balanced(none, 1), datasets.partner_anchor(none), datasets.head_and_tail(none, 1, 1, 1), datasets.hold_out(none, 0.5, 1)):
        assert df.count() == 0
    assert corpus.exact_quantiles(none, "ref_score", "query_id", (0.5,)).count() == 0


def test_tri_state_survives_export(spark):
    data = [("q", "n", 0, v, ["t"], "p", 0.1) for v in (True, False, None)]
    df = spark.createDataFrame(data, "query string, novel_id string, pool_rank int, rule_verdict boolean, constraint_terms array<string>, prompt string, partner_anchor double")
    truth = datasets.exported(df, "s").select("reward_model.ground_truth")
    assert sorted(r[0] for r in truth.collect()) == ["false", "none", "true"]
    assert {r[0] for r in truth.select(datasets.tri_state(F.col("ground_truth"))).collect()} == {True, False, None}
    assert spark.range(1).select(decide.checkable(F.array(F.lit(" 系统 ")))).first()[0]
