"""Packing token sequences by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into whole sequences and a rest.
The lengths' histogram, never more rows than a sequence has tokens, goes to
the driver; it places lengths from the longest to the shortest, each into the
packs that are filled least, and counts packs by pattern. A pattern's places
then own ranges of ranks among the pieces of a length, and each piece finds
its place by its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage
from .tokens import encoder, vocabulary_path
from .workers import slices, tidied

_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (packs, [(length, how many of it in each pack), ...]).

    Lengths go from the longest to the shortest into the packs with the most
    room. Where no open pack has room, new packs take as many pieces of the
    length as they hold.
    """
    done: list[tuple[int, list[tuple[int, int]]]] = []
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(left: int, packs: int, items: list[tuple[int, int]]) -> None:
        if left:
            room.setdefault(left, []).append((packs, items))
        else:
            done.append((packs, items))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            widest = max(room, default=0)
            if widest < length:
                each = min(n, size // length)
                packs = n // each
                put(size - each * length, packs, [(length, each)])
                n -= packs * each
                continue
            packs, items = room[widest].pop()
            if not room[widest]:
                del room[widest]
            each = min(widest // length, max(1, n // packs))
            used = min(packs, n // each)
            if used < packs:
                put(widest, packs - used, items)
            put(widest - each * length, used, [*items, (length, each)])
            n -= used * each
    return [*done, *(x for some in room.values() for x in some)]


def _pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, size: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary_path(vocabulary), end_id)
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.encode(batch.column(1).to_pylist()), strict=True):
                n, view = len(ids) // 4, memoryview(ids)
                for start in range(0, n, size):
                    piece = view[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], _NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidied(cut), ", ".join(f"{c} long" for c in _NAMES))


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 0,
    size: int = 1024,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null text counts as empty: its end id is a piece of its own. Rows that
    repeat an id are packed as documents of their own; a null id is kept as
    null. An empty table gives no rows; other columns are ignored.

    Ranks within a length are sums over 4096 buckets of the pieces' hash plus
    a rank within the bucket, so that a length that most documents share
    is not gathered in one task.
    """
    pieces = stage(_pieces(docs, id_col, text_col, vocabulary, end_id, size), "pieces").withColumn(
        "h", F.xxhash64("doc_id", "start", "ids_crc32")
    )
    pieces = pieces.withColumn("bucket", F.shiftrightunsigned("h", 52))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for packs, items in shortest_pack_first(histogram, size):
        offset = 0
        for length, each in items:
            slots.append((length, taken[length], packs, sequence, offset, each))
            taken[length] += packs * each
            offset += length * each
        sequence += packs
    slots.sort()
    table = np.array(slots or [(0,) * 6], "i8")
    keys = table[:, 0] << 48 | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = length.to_numpy("i8"), rank.to_numpy("i8")
        slot = table[np.searchsorted(keys, size << 48 | rank, "right") - 1]
        nth = rank - slot[:, 1]
        return pd.DataFrame({"sequence_id": slot[:, 3] + nth % slot[:, 2], "offset": slot[:, 4] + nth // slot[:, 2] * size})

    prior = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "bucket").orderBy("h", "doc_id", "start")
    ranked = pieces.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select(*[F.col("doc_id").alias(id_col), *_NAMES[1:]], "at.sequence_id", "at.offset")
