"""The search's worker: its memory, and its order where scores tie."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from inkwell.operators import retrieval


def batches(keys, vectors, size=10_000):
    for i in range(0, len(keys), size):
        part = vectors[i : i + size]
        ends = np.arange(len(part) + 1, dtype="i4") * vectors.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.ListArray.from_arrays(ends, part.ravel())], ["id", "v"])


def found(ids, matrix, k, keys, vectors, **held):
    out = pa.Table.from_batches(retrieval._best(ids, matrix, k, **held)(batches(keys, vectors)))
    return sorted(zip(out["q"].to_pylist(), (-out["score"].to_numpy()).tolist(), out["id"].to_pylist()))


@pytest.mark.parametrize("k", [10, 40])
def test_memory_does_not_grow_with_queries_or_rows(k):
    rng = np.random.default_rng(3)
    peaks = []
    for n, m in ((256, 2_000), (2048, 16_000)):
        work = retrieval._best(np.arange(n), rng.normal(size=(n, 4)), k)
        rows = list(batches(np.arange(m), rng.normal(size=(m, 4)).astype("f4")))
        tracemalloc.start()
        list(work(rows))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 48


def test_ties_go_by_key_in_any_slices():
    rng = np.random.default_rng(4)
    keys, vectors = rng.permutation(300), rng.integers(-1, 2, (300, 3)).astype("f4")
    ids, matrix = np.arange(7) * 5, rng.integers(-1, 2, (7, 3)).astype("f8")
    scores = (matrix @ vectors.T.astype("f8")).round(9)
    for k in (1, 4, 299, 400):
        want = sorted(x for i, q in enumerate(ids.tolist()) for x in sorted((q, -s, int(v)) for s, v in zip(scores[i].tolist(), keys))[:k])
        for held in (1, 50, 1000, 1 << 18):
            assert found(ids, matrix, k, keys, vectors, held=held) == want
