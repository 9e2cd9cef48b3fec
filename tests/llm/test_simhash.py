from __future__ import annotations

import re

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from inkwell.llm import components, simhash


def slow_print(text, width=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits):
    """The least id reachable, by brute force over all pairs."""
    values = sorted(set(prints.values()))
    array = np.array(values, "u8")
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= bits).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for d, p in prints.items():
        r = find(values.index(p))
        least[r] = min(least.get(r, d), d)
    return {d: least[find(values.index(p))] for d, p in prints.items()}


def test_fingerprints(documents, hard):
    for df in (documents, hard):
        for r in df.where("doc_id IS NULL OR doc_id <> 5").collect():
            assert simhash.fingerprint(r["text"]) == slow_print(r["text"])


@pytest.mark.parametrize("bits", [1, 3, 4])
@pytest.mark.parametrize(("n", "cell"), [(10, 4096), (10**7, 4096), (10, 3)])
def test_components_agree_with_brute_force(spark, bits, n, cell, monkeypatch):
    """Chains of fingerprints that differ by a few bits, for several grids,
    and with cells that count as crowded."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(3)
    values = [int(rng.integers(0, 2**64, dtype="u8"))]
    for _ in range(700):
        base = values[rng.integers(len(values))] if rng.random() < 0.8 else int(rng.integers(0, 2**64, dtype="u8"))
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            base ^= 1 << int(b)
        values.append(base)
    values += [0, 2**64 - 1, 1 << 63, (1 << 63) | 1, 3 << 62]
    want = slow_components(dict(enumerate(values)), bits)
    signed = [(i, v - 2**64 if v >> 63 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(signed, "id long, fp long")
    classes = df.groupBy("fp").agg(F.min("id").alias("least"))
    found = components.components(simhash.links(classes.select("fp"), n, bits))
    member = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = member.groupBy("root").agg(F.min("least").alias("c"))
    got = df.join(member.join(roots, "root").select("fp", "c"), "fp").select("id", "c")
    assert dict(rows(got, "id")) == want


def test_small_arrow_batches_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**63))
    values = {base}
    while len(values) < 400:
        near = base
        for b in rng.integers(0, 63, 3):
            near ^= 1 << int(b)
        values.add(near)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = components.components(simhash.links(df, len(values), 4))
        assert found.select("root").distinct().count() == len(set(slow_components(dict(enumerate(values)), 4).values()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_table(documents):
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in documents.collect()}
    want = slow_components(prints, 4)
    got = rows(simhash.near_duplicates(documents), "doc_id")
    assert got == [(d, f"{prints[d]:016x}", want[d]) for d in sorted(prints)]


def test_hard_rows(hard, clashing, none):
    found = simhash.near_duplicates(hard)
    assert found.count() == hard.count()
    by_id = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    assert by_id[1]["component_id"] == by_id[6]["component_id"] == -5
    assert by_id[2]["fingerprint"] == "0" * 16 and by_id[2]["component_id"] == by_id[3]["component_id"] == by_id[4]["component_id"] == 2
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and {-5, 2} <= {r["doc_id"] for r in kept.collect()}
    assert simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.range(600).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = components.components(edges)
    assert found.count() == 601 and found.select("root").distinct().collect()[0]["root"] == 0
    assert components.components(edges.where("u < 0")).count() == 0


def test_one_row_a_component_stays(spark):
    """Null ids and repeated ids with different texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(1, ""), (None, None), (None, a), (None, b), (None, b.upper()), (4, c), (4, "quite another text"), (3, c.upper()), (6, "said twice"), (6, "said twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, ""), (None, a), (None, b), (4, "quite another text"), (3, c), (6, "said twice")], key=str)
