"""Exact vector search, query expansion and the merge of several searches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decide
from ..functions.answers import expanded, parse_expansion
from ..functions.text import strip as trimmed
from ..functions.vocab import HINTS
from ..schemas import require_columns
from . import preferences

#: Bound on query vectors of one block; a block is a matrix in every task.
BLOCK = 4096


def check_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows, with an error at run time for a vector that is null, empty, or
    holds a number that is not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad
    return rows.withColumn(vector, F.when(good, F.col(vector)).otherwise(F.raise_error(F.lit("vectors must be finite and not empty"))))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _top(scored: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    order = W.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, k: int, *, vector: str = "embedding", key: str = "vec_id", query_key: str = "query_id", block: int = BLOCK) -> DataFrame:
    """Exact top k of every query against all rows, by matrix products.

    Queries are taken in blocks of at most ``block`` rows, each a matrix that
    every task holds; a task keeps the k best of its rows for each query, and
    a window merges them. The corpus is read once a block and never
    shuffled. Scores are rounded to nine places; ties go by key. Vectors that
    are null have no score; those of another size than the queries', or with
    numbers that are not finite, are an error.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    vectors = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).alias("v"))
    out = None
    for part in _blocks(vectors, block):
        ids = np.array([r["q"] for r in part])
        if len({len(r["v"]) for r in part}) > 1:
            raise ValueError("query vectors differ in size")
        matrix = np.array([r["v"] for r in part], "f8")
        if not matrix.size or not np.isfinite(matrix).all():
            raise ValueError("query vectors must be finite and not empty")
        found = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(
            _best(ids, matrix, k), "q long, id long, score double"
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], "q long, id long, score double")
    return _top(out.select(F.col("q").alias(query_key), F.col("id").alias(key), "score"), k, query_key, key)


def _blocks(vectors: DataFrame, block: int) -> Iterator[list]:
    held = []
    for row in vectors.orderBy("q").toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _best(ids: np.ndarray, matrix: np.ndarray, k: int, held: int = 1 << 18):
    """The ``k`` best rows of a task for each query. Rows are scored in slices
    of about ``held`` scores. Those that reach a query's k-th best are kept,
    and put in order once there are ``held``, so that a task's memory grows
    neither with a batch nor with the rows, and with the queries by ``k``
    scores each."""
    step = max(1, held // max(len(ids), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Query, score and key of the best, and of what may be; a query's ``least`` is its k-th best.
        found, more = [(np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "i8"))], 0
        least = np.full(len(ids), -np.inf)
        for part in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            column = part.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            if (sizes != matrix.shape[1]).any():
                raise ValueError(f"vectors of {sizes[sizes != matrix.shape[1]][0]} numbers, queries of {matrix.shape[1]}")
            rows = np.asarray(column.flatten(), "f8").reshape(part.num_rows, -1)
            if not np.isfinite(rows).all():
                raise ValueError("vectors must be finite")
            scores = matrix @ rows.T
            # Rounded, so that equal vectors tie wherever they stand in a block.
            q, r = np.nonzero(np.round(scores, 9, out=scores) >= least[:, None])
            found.append((q, scores[q, r], part.column(0).to_numpy()[r]))
            more += len(q)
            if more >= held:
                found, more = [_cut(found, k, least)], 0
        q, score, key = _cut(found, k, least)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(key), pa.array(score)], ["q", "id", "score"])

    return run


def _cut(found: list[tuple[np.ndarray, ...]], k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query, in order; sets ``least`` to the last of them."""
    q, score, key = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, -score, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    last = place == k - 1
    least[q[last]] = score[order[last]]
    kept = order[place < k]
    return q[place < k], score[kept], key[kept]


def hint_query(positive: Sequence[str], negative: Sequence[str], hints=HINTS) -> str | None:
    """All hints of a preference's terms as one query, or None."""
    words = [w for term in [*positive, *(f"不{t}" for t in negative)] for w in hints.get(term, ())]
    return " ".join(dict.fromkeys(words)) or None


def expand(raw: str, positive: Sequence[str] = (), negative: Sequence[str] = (), answer: str | None = None, most: int = 5) -> list[dict]:
    """The raw query, its hints and a model's variants: text, source, weight.

    Texts are distinct and at most ``most``; an answer that cannot be read
    adds none.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    hints = hint_query(positive, negative)
    found = [{"text": raw.strip(), "source": "raw", "weight": 1.0}]
    found += [{"text": hints, "source": "domain_hints", "weight": 0.8}] if hints else []
    found += expanded(answer)
    return _distinct(found)[:most]


def variants(queries: DataFrame, *, most: int = 5, hints=HINTS) -> DataFrame:
    """``expand`` for many requests: (query_id, seq, text, source, weight).

    ``queries`` has query_id and query, and ``answer`` if a model was asked.
    """
    parsed = queries.withColumn("__p", preferences.parse(F.col("query")))
    known = F.create_map(*[x for k, ws in hints.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])
    terms = F.concat("__p.positive", F.transform("__p.negative", lambda t: F.concat(F.lit("不"), t)))
    words = F.flatten(F.filter(F.transform(terms, lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull()))
    one = lambda text, source, weight: F.struct(text.alias("text"), F.lit(source).alias("source"), F.lit(weight).alias("weight"))
    fixed = F.array(one(trimmed(F.col("query")), "raw", 1.0), one(F.array_join(F.array_distinct(words), " "), "domain_hints", 0.8))
    told = parse_expansion(F.col("answer")) if "answer" in queries.columns else F.array().cast("array<struct<text:string,source:string,weight:double>>")
    found = F.filter(F.concat(fixed, F.coalesce(told, F.array().cast("array<struct<text:string,source:string,weight:double>>"))), lambda x: x["text"] != "")
    rows = parsed.select("query_id", found.alias("__f")).withColumn("__t", F.transform("__f", lambda x: x["text"]))
    first = F.filter("__f", lambda x, i: F.array_position(F.col("__t"), x["text"]) == i + 1)
    return rows.select("query_id", F.posexplode(F.slice(first, 1, most)).alias("seq", "v")).select("query_id", "seq", "v.*")


def _distinct(found: list[dict]) -> list[dict]:
    seen: dict[str, dict] = {}
    for q in found:
        if q["text"] and q["text"] not in seen:
            seen[q["text"]] = q
    return list(seen.values())


def merge(hits: DataFrame, *, group: Sequence[str] = (), total: Column | int, key: str = "novel_id", k: int | None = None) -> DataFrame:
    """Hits of several queries as one ranked list of candidates.

    ``hits`` has seq (the order of the queries), source, weight, rank and
    score. best_rank is the rank in the query with the best score, the first
    of them on a tie, not the least rank. Sources are distinct, in the order
    in which they first hit. Ties in the retrieval score go to the candidate
    that was seen first.
    """
    require_columns(hits, "seq", "source", "weight", "rank", "score", key, *group)
    hits = hits.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    hit = F.struct("seq", "rank", "source", "weight", "score")
    out = hits.groupBy(*group, key).agg(
        F.max("score").alias("best_score"),
        F.max_by("rank", F.struct("score", -F.col("seq"), -F.col("rank"))).alias("best_rank"),
        F.count(F.lit(1)).alias("matched"),
        F.max("weight").alias("source_weight"),
        F.array_sort(F.collect_list(hit)).alias("per_query"),
        F.min(F.struct("seq", "rank")).alias("seen"),
        *([F.lit(total).alias("__n")] if isinstance(total, int) else [F.max(total).alias("__n")]),
    )
    out = out.withColumn("sources", F.array_distinct(F.transform("per_query", lambda x: x["source"])))
    norm = F.greatest(F.col("__n"), F.lit(1))
    out = out.withColumn("retrieval_score", decide.retrieval_score(F.col("best_score"), F.col("matched"), norm, F.greatest(F.col("source_weight"), F.lit(0.0))))
    order = (W.partitionBy(*group) if group else W.partitionBy(F.lit(1))).orderBy(F.desc("retrieval_score"), "seen", key)
    out = out.withColumn("retrieval_rank", F.row_number().over(order)).drop("__n", "seen")
    return out if k is None else out.where(F.col("retrieval_rank") <= k)


def source_counts(candidates: DataFrame, sources: str = "sources") -> DataFrame:
    return candidates.select(F.explode(sources).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("candidates"))


def title_status(candidates: DataFrame, wanted: str, *, title: str = "title_guess", rank: str = "retrieval_rank") -> DataFrame:
    """Whether and where a title that contains ``wanted`` stands."""
    found = F.col(title).contains(wanted)
    return candidates.agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("found"), F.min(F.when(found, F.col(rank))).alias("first_rank"))
