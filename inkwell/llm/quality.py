"""Quality scores by co-training two views of a document.

One classifier sees what a text is made of (hashed byte trigrams), the other
where it comes from and how it is laid out (source, language, length,
lines). Each round, each view labels the documents of an unlabelled pool that
it is surest about, and the other view trains on them too. Both views are
then calibrated on labelled rows that took no part in training, and a
document's score combines their calibrated log-odds.

Fitting uses bounded samples: ``labelled`` labelled documents and a pool of
``pool`` unlabelled ones, both the first by the hash of their id. All
documents are scored, by their whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import give_back
from .workers import tidied

TRIGRAMS = 2048
_SOURCES, _LANGS = 64, 16
LAYOUT = _SOURCES + _LANGS + 8


def content_view(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; a text of under
    three bytes has none."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1").astype("u4")
    if len(raw) < 3:
        return np.zeros(TRIGRAMS, "f4")
    code = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)
    counts = np.bincount(code >> np.uint32(21), minlength=TRIGRAMS)
    return np.sqrt(counts / counts.sum()).astype("f4")


def metadata_view(text: str | None, source: str | None, lang: str | None) -> np.ndarray:
    """Hashed source and language, length and line layout."""
    out = np.zeros(LAYOUT, "f4")
    out[zlib.crc32((source or "").encode()) % _SOURCES] = 1
    out[_SOURCES + zlib.crc32((lang or "").encode()) % _LANGS] = 1
    lines = (text or "").split("\n")
    sizes = [len(x) for x in lines]
    size = max(sum(sizes), 1)
    out[_SOURCES + _LANGS :] = (
        math.log1p(size) / 10,
        size < 100,
        math.log1p(len(lines)) / 5,
        math.log1p(size / len(lines)) / 10,
        math.log1p(max(sizes)) / 10,
        max(sizes) / size,
        1 - len(set(lines)) / len(lines),
        sum(1 for n in sizes if n < 20) / len(lines),
    )
    return out


def _fit(parts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, w: np.ndarray | None = None, *, steps: int = 150, rate: float = 0.1, ridge: float = 1e-4):
    """Logistic regression by Adam on the rows of all ``parts``, which are
    never put into one matrix; the last weight is the bias."""
    w = np.zeros(parts[0].shape[1] + 1, "f4") if w is None else w.copy()
    first, second = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        z = np.concatenate([x @ w[:-1] for x in parts]) + w[-1]
        error = (weight * (_sigmoid(z) - y)).astype("f4")
        ends = np.cumsum([len(x) for x in parts])
        down = sum(e @ x for e, x in zip(np.split(error, ends[:-1]), parts, strict=True))
        grad = np.append(down + ridge * w[:-1], error.sum()).astype("f4")
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of both views, their calibrations and how they combine."""

    views: list[np.ndarray]
    scales: list[tuple[float, float]]
    mixed: np.ndarray

    def log_odds(self, view: int, x: np.ndarray) -> np.ndarray:
        w, (a, b) = self.views[view], self.scales[view]
        return np.clip(a * (x @ w[:-1] + w[-1]) + b, -15, 15)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, ...]:
        one, two = self.log_odds(0, content), self.log_odds(1, metadata)
        return _sigmoid(self.mixed[0] * one + self.mixed[1] * two + self.mixed[2]), _sigmoid(one), _sigmoid(two)


def _calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt scaling by Newton's method, with smoothed targets and a small
    ridge towards slope one."""
    x = np.column_stack([*np.atleast_2d(z), np.ones(y.shape[0])])
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    prior = np.append(np.full(x.shape[1] - 1, 1 / (x.shape[1] - 1)), 0)
    w = prior.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - t) + 0.1 * (w - prior))
        w -= np.clip(step, -2, 2)
    return w


def co_train(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], *, rounds: int = 3, share: float = 0.1, sure: float = 0.95) -> Model | None:
    """Fits both views on labelled rows ``x`` and the unlabelled ``pool``.

    A fifth of the labelled rows is kept for calibration. In each round a
    view passes on up to ``share`` of the pool, as many of each label as its
    own share of that label asks for, surest first and only if it gives them
    at least ``sure`` (among its own predictions of that label, calibrated).
    None if the labels lack a class.
    """
    held = np.arange(len(y)) % 5 == 4
    # The rows that are kept go last, so that both parts are views. The list gets the matrices in that order, so that no other ones remain.
    order = np.argsort(held, kind="stable")
    for i in range(len(x)):
        x[i] = x[i][order]
    y, held, n = y[order], held[order], int((~held).sum())
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        return None
    views: list[np.ndarray | None] = [None, None]
    given = [(np.zeros(0, "i8"), np.zeros(0)) for _ in x]
    scales = [(1.0, 0.0)] * 2
    for r in range(rounds + 1):
        for v in (0, 1):
            rows, labels = given[v]
            target = np.concatenate([y[~held], labels])
            # Labelled rows count double, and both classes alike.
            weight = np.concatenate([np.full((~held).sum(), 2.0), np.ones(len(rows))])
            for c in (0, 1):
                weight[target == c] /= weight[target == c].sum()
            views[v] = _fit([x[v][:n], pool[v][rows]], target, weight, views[v], steps=300 if r == 0 else 100)
            z = x[v][n:] @ views[v][:-1] + views[v][-1]
            scales[v] = tuple(_calibrated(z, y[held]))
        if r == rounds:
            break
        for v in (0, 1):
            p = _sigmoid(scales[v][0] * (pool[v] @ views[v][:-1] + views[v][-1]) + scales[v][1])
            picked, labels = [], []
            for c, q in ((1, p), (0, 1 - p)):
                most = max(1, int(share * (r + 1) * len(p) * np.mean(y == c)))
                best = np.argsort(-q, kind="stable")[:most]
                best = best[q[best] >= sure]
                picked.append(best)
                labels.append(np.full(len(best), float(c)))
            given[1 - v] = (np.concatenate(picked), np.concatenate(labels))
    model = Model(views, scales, np.zeros(3))
    both = np.stack([model.log_odds(v, x[v][n:]) for v in (0, 1)])
    model.mixed = _calibrated(both, y[held])
    return model


def _features(rows: DataFrame) -> DataFrame:
    """(id, label, content, metadata) of a bounded sample, in sparse binary."""

    def viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, layout = [], []
            for text, source, lang in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                x = content_view(text)
                at = np.flatnonzero(x)
                content.append(at.astype("u2").tobytes() + x[at].tobytes())
                layout.append(metadata_view(text, source, lang).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(content, pa.binary()), pa.array(layout, pa.binary())],
                ["id", "label", "content", "metadata"],
            )

    return rows.select("id", "label", "text", "__source", "__lang").mapInArrow(tidied(viewed), "id long, label double, content binary, metadata binary")


def _context(docs: DataFrame) -> list[Column]:
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(f"__{c}") for c in ("source", "lang")]


def _matrices(rows: list) -> list[np.ndarray]:
    content = np.zeros((len(rows), TRIGRAMS), "f4")
    for i, r in enumerate(rows):
        n = len(r["content"]) // 6
        content[i, np.frombuffer(r["content"], "u2", n)] = np.frombuffer(r["content"], "f4", n, 2 * n)
    layout = [np.frombuffer(r["metadata"], "f4") for r in rows]
    return [content, np.array(layout, "f4").reshape(len(rows), LAYOUT)]


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    labelled: int = 5000,
    pool: int = 5000,
    **options,
) -> Model | None:
    """Trains on ``labelled`` labelled documents and ``pool`` unlabelled ones
    at most.

    A document with several labels has the one that most of them give, good
    on a tie; null labels and labels of unknown documents are not used. None
    if there are too few labels of either class.
    """
    give_back(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *_context(docs))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    rows = _features(texts.join(F.broadcast(chosen), "id")).collect()
    # No labelled document is in the pool, whether it is chosen or not.
    others = texts.select("id").where("id IS NOT NULL").join(known.select("id"), "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(pool)
    unknown = texts.join(F.broadcast(others.distinct()), "id").withColumn("label", F.lit(None).cast("double"))
    free = _features(unknown).collect()
    # Order by content too, so that rows that repeat an id come in one order.
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["content"]))
    free.sort(key=lambda r: (r["id"], r["content"]))
    y, x = np.array([r["label"] for r in rows]), _matrices(rows)
    del rows
    loose = _matrices(free)
    del free
    model = co_train(x, y, loose, **options)
    del x, loose
    give_back(docs.sparkSession)
    return model


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct of p_good, p_content and p_metadata for every row of ``docs``."""

    @F.pandas_udf("p_good double, p_content double, p_metadata double")
    def scored(text: pd.Series, source: pd.Series, lang: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(text), 256):
            some = [x.iloc[i : i + 256] for x in (text, source, lang)]
            content = np.stack([content_view(t) for t in some[0]])
            layout = np.stack([metadata_view(*x) for x in zip(*some, strict=True)])
            out.append(np.stack(model.score(content, layout), axis=1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3)), columns=["p_good", "p_content", "p_metadata"])

    return scored(F.col(text_col).cast("string"), *_context(docs))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with p_good, p_content, p_metadata and kept.

    A document is kept if p_good is at least ``threshold``. Without enough
    labels nothing is known: the scores are null and everything is kept. A
    null or empty text is scored by its other view and an empty content; a
    missing source or language column counts as null. Rows that repeat an id
    are scored one by one. Columns of these names in ``docs`` are replaced.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    names = ["p_good", "p_content", "p_metadata"]
    rest = [docs[c] for c in docs.columns if c not in (*names, "kept", "__s")]
    if model is None:
        return docs.select(*rest, *[F.lit(None).cast("double").alias(n) for n in names], F.lit(True).alias("kept"))
    scored = docs.select(*rest, scores(docs, model, text_col).alias("__s"))
    kept = F.col("__s.p_good") >= threshold
    return scored.select(*[c for c in scored.columns if c != "__s"], *[f"__s.{n}" for n in names], kept.alias("kept"))
