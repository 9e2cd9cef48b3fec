from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import rows

from inkwell.llm import queries, substrings


def brute(data, window):
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in data}
    first: dict[tuple, tuple] = {}
    order = sorted(words, key=lambda d: (d is not None, d or 0))
    for d in order:
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    out = []
    for d in order:
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
    return sorted(out, key=str)


def got(df, **options):
    return rows(substrings.drop_repeats(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"))


@pytest.mark.parametrize(("window", "inner"), [(3, 2), (5, 5), (20, 8)])
def test_random_texts(spark, window, inner):
    rng = random.Random(window)
    data = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    data += [(200 + i, f"x{i} {passage} y{i}") for i in range(30)] + [(300, None), (301, ""), (302, passage * 3)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert got(df, window=window, inner=inner) == brute(df.collect(), window)


def test_whole_table(documents):
    assert got(documents) == brute(documents.collect(), 20)


def test_small_batches(spark, documents):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert got(documents) == brute(documents.collect(), 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("width", [1, 2])
def test_windows_that_share_a_hash(spark, documents, width):
    rng = random.Random(width)
    data = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(9)
    assert got(df, window=9, inner=3, width=width) == brute(df.collect(), 9)
    assert got(documents, width=width) == brute(documents.collect(), 20)


def test_passage_in_every_document(spark):
    passage = " ".join(f"p{i}" for i in range(200))
    data = [(i, f"x{i} {passage} y{i} {passage}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(50)
    assert got(df) == brute(df.collect(), 20)


@pytest.mark.parametrize("rows_held", [1, 50])
def test_held_rows_are_thinned(monkeypatch, rows_held):
    monkeypatch.setattr(substrings, "_HELD", rows_held)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(30)) for _ in range(80)]
    blocks = [substrings._runs(np.array([i]), [t], 6, 2, 6) for i, t in enumerate(texts)]
    table = pa.Table.from_batches(blocks).sort_by([("key", "ascending"), ("doc", "ascending"), ("start", "ascending")])
    runs = list(substrings._proposed(iter(table.to_batches(max_chunksize=7)), 6))
    gone = {(x["doc"], x["start"] + j) for b in runs for x in b.to_pylist() for j in range(x["length"])}
    first, want = set(), set()
    for d, t in enumerate(texts):
        for i in range(25):
            window = tuple(t.split()[i : i + 6])
            if window in first:
                want.add((d, i))
            first.add(window)
    assert gone == want


def test_repeats_within_a_document_and_intervals(spark):
    text = " ".join(f"w{i}" for i in range(30)) + " gap " + " ".join(f"w{i}" for i in range(30))
    found = substrings.drop_repeats(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, gone string")).first()
    assert found["n_removed"] == 30 and [(x["start"], x["end"]) for x in found["removed"]] == [(31, 61)]


def test_hard_rows(hard, clashing, none):
    found = substrings.drop_repeats(clashing).collect()
    assert len(found) == hard.count()
    words = {r["n_words"] for r in found if r["doc_id"] == 5}
    assert words == {60_000}
    assert all(r["n_removed"] == 0 for r in found if r["doc_id"] != 5)
    long = next(r for r in found if r["doc_id"] == 5)
    assert long["n_removed"] == 60_000 - 977
    assert substrings.drop_repeats(none).count() == 0


def test_query(spark, sf):
    assert queries.op4_substring_dedup(spark, sf).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
