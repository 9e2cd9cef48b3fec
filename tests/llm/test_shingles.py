from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest

from inkwell.llm import shingles, simhash


def slow_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_kept(docs):
    """The least id of each component, by brute-force Jaccard over all pairs."""
    sets = {d: slow_set(t) for d, t in docs}
    order = sorted(sets)
    root = {d: d for d in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted({find(d) for d in order})


def edited(rng, words, share):
    return [f"e{rng.integers(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [3, 256])
def test_near_copies_against_brute_force(spark, sf, monkeypatch, block):
    """Copies about the threshold, in groups of more than one block."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(30, 300))]
        docs += [" ".join(edited(rng, base, s)) for s in [0, *rng.choice([0.005, 0.01, 0.02, 0.04], 9)]]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(docs)), docs, strict=True)]
    want = slow_kept(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == want
    assert len(want) < len(simhash.drop_near_duplicates(df).collect()) < len(docs)


def test_documents_against_brute_force(spark, documents, sf):
    want = slow_kept([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents, sf).collect()) == want


def test_hard_rows(hard, clashing, none):
    kept = shingles.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["-5", "2", "5", "7", "8", "None"]
    assert shingles.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("light", [0, 256])
def test_copies_of_copies_in_one_group(spark, sf, monkeypatch, light):
    """Edits that are passed on, cuts and own edits about the centre, where
    rounds of small blocks leave most links to the last comparison."""
    monkeypatch.setattr(shingles, "BLOCK", 2)
    monkeypatch.setattr(shingles, "LIGHT", light)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 5000, 70)]
    texts = [base]
    for _ in range(240):
        old = texts[rng.integers(len(texts))] if rng.random() < 0.6 else base
        texts.append(edited(rng, old[: len(old) - int(rng.choice([0, 0, 1, 4]))], rng.choice([0.01, 0.02, 0.04])))
    docs = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == slow_kept(docs)


@pytest.mark.parametrize("fingerprint", [None, 5])
def test_simhash_proposes_and_shingles_verify(spark, sf, monkeypatch, fingerprint):
    """No two sets share a band here: fingerprints alone bring copies together,
    and where they are all alike, only the similar sets are dropped."""
    monkeypatch.setattr(shingles, "band_keys", lambda s: np.full(shingles.BANDS, shingles.node_of(s), "i8").view("u8"))
    if fingerprint is not None:
        monkeypatch.setattr(shingles, "fingerprint_of", lambda s: fingerprint)
    rng = np.random.default_rng(9)
    docs = []
    for _ in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 1000)]
        docs += [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(0, 1000, 250)] + [" ".join(edited(rng, base, 0.06))]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(docs)), docs, strict=True)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = slow_kept(docs)
    assert len(want) == 8
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == want


def test_fingerprint_of_a_set():
    held = np.array([1, 3, 5, 1 << 63], "u8")
    assert shingles.fingerprint_of(held) == 1 and shingles.fingerprint_of(held[:0]) == 0
    assert shingles.fingerprint_of(held[3:]) == -(1 << 63)
