from __future__ import annotations

import io
import json
import urllib.error

import pytest
from compare import rows
from pyspark.sql import functions as F

from inkwell.functions import decide
from inkwell.operators import retrieval
from inkwell.plans import judging, pools
from inkwell.sources import http

QUERIES = "query_id string, query string, wanted array<string>, unwanted array<string>, answer string"


def encoder():
    """A vector from the characters of a text, so that equal words meet."""

    def embed(texts, role):
        out = []
        for t in texts:
            v = [1e-6] * 16
            for c in t:
                v[ord(c) % 16] += 1.0
            out.append(v)
        return out

    return embed


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["修仙", "慢热", "系统", "直播", "都市", "末世", "重生", "校园"]
    books = [(f"n{i:02d}", i, f"书{i}", words[i % 8] * (1 + i % 3) + words[(i * 3) % 8]) for i in range(40)]
    df = spark.createDataFrame(books, "novel_id string, row long, title_guess string, profile_text string")
    from inkwell.protocols import embed

    vectors = embed(df.select("novel_id", "row", F.col("profile_text").alias("t")), encoder, text_col="t", role="document").drop("t")
    folds = df.select("novel_id", F.when(F.col("row") % 5 == 0, "eval").otherwise("train").alias("fold")).where("row <> 7")
    densities = df.select("novel_id", F.lit(100).alias("char_count"), *[((F.col("row") % m) * 2.0).alias(w) for w, m in (("系统", 3), ("任务奖励", 1), ("直播", 2))]).where("row <> 9")
    return pools.Corpus(vectors.cache(), df.drop("row"), folds, densities)


@pytest.fixture(scope="module")
def queries(spark):
    answer = json.dumps({"expanded_queries": [{"text": "升级流", "weight": 0.5}, {"text": "修仙 不要系统"}]})
    data = [("q1", "修仙 不要系统", ["修仙"], ["系统"], answer), ("q2", "都市 不要后宫", ["都市"], ["后宫"], None), ("q3", "仙侠", ["仙侠"], [], "broken")]
    return spark.createDataFrame(data, QUERIES)


def test_variants_agree_with_expand(queries):
    found = {}
    for r in retrieval.variants(queries).orderBy("query_id", "seq").collect():
        found.setdefault(r["query_id"], []).append({"text": r["text"], "source": r["source"], "weight": r["weight"]})
    parts = {"q1": (["修仙"], ["系统"]), "q2": (["都市"], ["后宫"]), "q3": (["仙侠"], [])}
    for r in queries.collect():
        assert found[r["query_id"]] == retrieval.expand(r["query"], *parts[r["query_id"]], r["answer"])


def test_pools_keep_the_fold_and_count_ranks_anew(corpus, queries):
    found = pools.pools(queries, corpus, encoder, per_query=20, size=8, fold="train").collect()
    folds = {r["novel_id"]: r["fold"] for r in corpus.folds.collect()}
    for q in ("q1", "q2", "q3"):
        mine = sorted((r["pool_rank"], r["retrieval_rank"], r["novel_id"]) for r in found if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(8)) and [m[1] for m in mine] == sorted(m[1] for m in mine)
        assert all(folds[m[2]] == "train" for m in mine)


def test_verdicts_of_rows_agree_with_those_of_literals(corpus):
    table = corpus.densities.join(decide.density_map(corpus.densities), "novel_id")
    for terms in (["系统"], ["系统", "直播"], ["后宫"], []):
        column = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
        both = table.select(decide.verdict_of(column, F.col("densities")).alias("a"), decide.rule_verdict(terms, lambda w: F.col(w) if w in table.columns else F.lit(0.0)).alias("b"))
        assert all(r["a"] == r["b"] for r in both.collect())


def test_episodes_are_balanced(corpus, queries):
    found = pools.episodes(queries, corpus, encoder, seed=1, most=None, per_query=40, size=30).collect()
    assert {r["query_id"] for r in found} == {"q1"}
    assert sum(r["rule_verdict"] for r in found) * 2 == len(found) > 0
    assert all("修仙" in r["prompt"] for r in found)
    few = pools.episodes(queries, corpus, encoder, seed=1, most=2, per_query=40, size=30)
    assert few.count() == 2


def teacher():
    def answer(prompt):
        if "书3\n" in prompt:
            raise OSError
        return json.dumps({"llm_match_score": 0.6, "confidence": "high", "matched_preferences": ["修仙"], "violated_preferences": ["有后宫情节"], "risk_flags": ["可能含系统"], "reason": "系统少"}, ensure_ascii=False)

    return answer


@pytest.fixture(scope="module")
def cache(spark):
    return spark.createDataFrame([], "cache_key string, seq bigint, response string")


def test_fine_tuning_samples(corpus, queries, cache):
    found = pools.fine_tuning(queries, corpus, encoder, teacher, seed=1, cache=cache, head=4, tail=4, per_query=40, size=30).collect()
    assert {r["label_source"] for r in found} == {"rule", "rule_abstained", "teacher"}
    assert not any(r["title_guess"] == "书3" for r in found)
    for r in found:
        target = json.loads(r["target"])
        assert set(target) == {"llm_match_score", "confidence", "matched_preferences", "violated_preferences", "risk_flags", "reason"}
        assert (r["selection"] == "head") == (r["pool_rank"] < 4)
        if r["label_source"] == "rule":
            assert target["violated_preferences"] == (["系统"] if r["rule_verdict"] else []) and target["risk_flags"] == []
        elif r["query_id"] == "q2":
            assert target["violated_preferences"] == ["后宫"] and r["rule_verdict"] is None
        else:
            assert target["violated_preferences"] == []


def test_evaluation_runs_both_systems(corpus, queries, cache):
    out = pools.evaluate(queries, corpus, encoder, teacher, cache=cache, top_k=5, scored=6, per_query=20, size=20)
    found = out.groupBy("query_id", "system_variant").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    assert rows(found.select("query_id", "system_variant", "n", "last")) == [(q, s, 5, 5) for q in ("q1", "q2", "q3") for s in ("baseline", "full")]


def test_expansions_use_the_cache(queries, cache, spark):
    first = pools.expansions(queries.drop("answer"), cache, teacher).collect()
    known = spark.createDataFrame([(first[0]["cache_key"], 1, "known")], cache.schema)
    again = {r["cache_key"]: r for r in pools.expansions(queries.drop("answer"), known, teacher).collect()}
    assert again[first[0]["cache_key"]]["provider"] == "cache" and len(again) == 3


def test_synthesis(corpus):
    tasks = pools.seeds(corpus.profiles, 6, 3)
    assert tasks.count() == 6 and tasks.select("required").distinct().count() == 6

    def writer():
        return lambda prompt: json.dumps({"queries": [{"query": "想看慢热修仙不要系统", "unwanted": ["系统"]}, {"query": "系统流但是不要系统", "unwanted": ["系统"]}, {"query": "短"}]}, ensure_ascii=False)

    made = pools.synthesize(tasks, writer)
    assert {r["query"] for r in made.collect()} == {"想看慢热修仙不要系统"} and made.where("constraint_checkable").count() == 6


RESULTS = "query_id string, system_variant string, rank int, novel_id string, title_guess string"


def test_judging(spark, queries):
    results = spark.createDataFrame([("q1", s, i, f"n{i}", f"书{i}") for s in ("a", "b") for i in range(5)], RESULTS)
    texts = spark.createDataFrame([(f"n{i}", "正文。" * 900 + f"号{i}") for i in range(4)], "novel_id string, text string")
    pinned = spark.createDataFrame([("q1", "n3", "pinned passage 3")], "query_id string, novel_id string, evidence string")
    tasks = judging.tasks(results, queries, texts, pinned=pinned).cache()
    assert tasks.count() == 4 and tasks.where("novel_id = 'n3'").first()["evidence"] == "pinned passage 3"

    def load():
        def answer(prompt):
            if "书0\n" in prompt:
                raise OSError
            if "书1\n" in prompt:
                return "no object"
            return '{"relevance_label": 2, "constraint_violation": true, "judge_confidence": "high"}'

        return answer

    none = spark.createDataFrame([], "cache_key string, seq bigint, response string")
    cost = {"price_in": 1.0, "price_out": 1.0}
    each = 2650 / 1e6
    judged = judging.judge(tasks, none, load, cap=each * 10, **cost)
    assert {r["novel_id"]: (r["status"], r["judge_relevance_label"]) for r in judged.collect()} == {"n0": ("failed", None), "n1": ("unparsed", None), "n2": ("judged", 2), "n3": ("judged", 2)}
    attached = judging.attach(results, judged)
    assert attached.count() == 10 and attached.where("judge_relevance_label = 2").count() == 4
    known = judged.where("novel_id = 'n2'").select("cache_key", F.lit(1).cast("long").alias("seq"), "response")
    again = judging.judge(tasks, known, load, cap=each * 3.5, **cost)
    assert [(r["status"], r["pairs"]) for r in judging.summary(again).orderBy("status").collect()] == [("cached", 1), ("failed", 1), ("judged", 1), ("unparsed", 1)]
    # The estimate for all that the cache lacks is asked for before any request.
    for df, cache, cap in ((tasks, none, 3.5), (tasks, known, 2.5), (tasks, none, 0.5)):
        with pytest.raises(judging.BudgetExceeded):
            judging.judge(df, cache, load, cap=each * cap, **cost)
    with pytest.raises(judging.BudgetExceeded):
        judging.judge(tasks, none, load, cap=each * 10, spent=each * 7, **cost)


def test_judging_by_reported_usage(spark, tmp_path):
    tasks = spark.createDataFrame([("q", f"n{i}", f"prompt {i}") for i in range(40)], "query_id string, novel_id string, prompt string")
    none = spark.createDataFrame([], "cache_key string, seq bigint, response string")

    def load():
        return lambda prompt: ('{"relevance_label": 1}' if "7" not in prompt else "nothing", 5_000, 300)

    cost = {"price_in": 1.0, "price_out": 1.0, "cap": 0.12}
    judged = judging.judge(tasks, none, load, waves=4, folder=f"file://{tmp_path}/waves", **cost)
    found = {r["status"]: r for r in judging.summary(judged).collect()}
    # Requests cost twice the estimate, unread answers too, so that the last waves find the cap reached.
    asked = sum(found[s]["pairs"] for s in ("judged", "unparsed"))
    assert found["skipped"]["pairs"] == 40 - asked > 0 and asked * 0.0053 >= 0.12 > (asked - 20) * 0.0053
    assert sum(r["cost"] for r in found.values()) == pytest.approx(asked * 0.0053) and found["unparsed"]["prompt_tokens"] % 5_000 == 0


def test_endpoint():
    calls, pauses = [], []
    point = http.Endpoint("http://127.0.0.1:1/v1", "m", attempts=3, pause=1.0)

    def send(_, prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, io.BytesIO())
        return {"choices": [{"message": {"content": "hello"}}], "usage": {"prompt_tokens": 3}}

    assert http.completer(point, send, pauses.append)("x") == "hello" and pauses == [1.0, 2.0]
    assert http.completer(point, send, pauses.append, metered=True)("x") == ("hello", 3, 0)

    def refuse(*_):
        calls.append(1)
        raise urllib.error.HTTPError("u", 400, "bad", {}, io.BytesIO())

    calls.clear()
    assert http.completer(point, refuse, pauses.append)("x") is None and len(calls) == 1
    assert http.usage({"usage": {"prompt_tokens": 3}}) == (3, 0) and http.usage({}) == (0, 0)
    assert http.content({"choices": []}) is None
    assert http.is_local("http://localhost:8000/v1") and not http.is_local("https://api.example.com")
