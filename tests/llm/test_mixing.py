from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from compare import rows
from pyspark.sql import functions as F

from inkwell.llm import mixing


def targets(sizes: dict, weights=(1, 2, 3), repeats=3):
    """Water filling, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= repeats * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= repeats * sizes[s]
            open_.remove(s)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def queued(found):
    """Times taken by id, source and place, by sorting all copies in one list."""
    size = {(r["no_source"], r["source"]): r["source_size"] for r in found}
    goal = {(r["no_source"], r["source"]): r["target"] for r in found}
    copies = []
    for r in found:
        key = hashlib.md5(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()).hexdigest()
        for turn in range(3 if r["size"] else 0):
            at = (turn * r["source_size"] + r["until"]) / r["target"]
            copies.append(((at, r["no_source"], r["source"], r["until"], key, turn), r["size"], r["doc_id"]))
    copies.sort(key=lambda c: c[0])
    out = {(r["doc_id"], r["no_source"], r["source"], r["until"]): 0 if r["size"] else 1 for r in found}
    words, spent, budget, over = dict.fromkeys(size, 0), 0, sum(size.values()), set()
    for at, n, doc in copies:
        s, spent = at[1:3], spent + n
        if spent > budget:
            if s in over or not abs(words[s] + n - goal[s]) < abs(words[s] - goal[s]):
                over.add(s)
                continue
            over.add(s)
        else:
            words[s] += n
        out[doc, *at[1:4]] += 1
    return out


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_targets_and_limits(request, table):
    df = request.getfixturevalue(table)
    data = df.collect()
    sizes = defaultdict(int)
    for r in data:
        sizes[r["source"]] += words(r["text"])
    want = targets(sizes)
    found = mixing.queue(df).collect()
    assert len(found) == len(data)
    source = {(r["doc_id"], words(r["text"])): r["source"] for r in data}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        s = None if r["no_source"] else r["source"]
        assert source[r["doc_id"], r["size"]] == s and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3
        taken[s] += r["taken"] * r["size"]
        largest[s] = max(largest[s], r["size"])
    # The cut goes through one document of a source, which is taken or not, whatever is nearer.
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] + max(largest.values()) / 2
    assert {(r["doc_id"], r["no_source"], r["source"], r["until"]): r["taken"] for r in found} == queued(found)


def test_reruns_and_partitions_agree(spark, documents):
    first = rows(mixing.queue(documents).select("doc_id", "taken"), "doc_id")
    assert first == rows(mixing.queue(documents.repartition(7)).select("doc_id", "taken"), "doc_id")


def test_mix_repeats_rows(documents, clashing):
    times = {r["doc_id"]: r["taken"] for r in mixing.queue(documents).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    found = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert found == {k: n for k, n in times.items() if n}
    assert mixing.mix(clashing).columns == clashing.columns


def test_empty_and_wordless(spark, none):
    assert mixing.queue(none).count() == mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"] * r["size"]) for r in mixing.queue(blank).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(blank).count() == 2


def test_a_budget(documents):
    found = mixing.queue(documents, budget=1000)
    # The words before the cut keep to it; beyond it a source takes one document at most, if that is nearer to its target.
    sources = found.groupBy("no_source", "source").agg(F.sum(F.col("taken") * F.col("size")).alias("words"), F.max("target").alias("target"), F.max("size").alias("most"))
    assert all(r["words"] <= r["target"] + r["most"] / 2 for r in sources.collect())


@pytest.mark.parametrize("ranges", ["1", "37"])
def test_ranges_do_not_change_the_cut(spark, documents, hard, ranges):
    want = [rows(mixing.queue(d).select("doc_id", "size", "taken")) for d in (documents, hard)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    found = [rows(mixing.queue(d).select("doc_id", "size", "taken")) for d in (documents, hard)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == want
