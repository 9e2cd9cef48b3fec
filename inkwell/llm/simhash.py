"""Near duplicates by SimHash, through per-segment bit counts.

A fingerprint's 64 bits form 32 segments of two; the vector of their bit
counts is its place in a grid. The Manhattan distance of two places is at
most the Hamming distance of the fingerprints, so fingerprints within
``bits`` differing bits lie within ``bits`` of each other there. With the
segments in ``bits + z`` blocks, at least ``z`` blocks then agree in all
counts: each choice of ``z`` blocks is one table of grid cells, and a cell is
joined over the range of the remaining bits' count, which may differ by
``bits`` at most, and by the Manhattan distance of all counts. What is left
is verified on the fingerprints themselves.

A cell that very many fingerprints share is not compared pair by pair:
fingerprints within ``bits`` of each other have a point in common that is
within half of that of either, so they meet at the points around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .skew import SALTS, with_totals
from .staging import stage
from .workers import tidied

_PAIRS = 0x5555555555555555
#: Fingerprints of a cell that are compared pair by pair.
CELL = 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text as an unsigned 64-bit number.

    A-Z are lower-cased; shingles are ``width`` words joined by spaces,
    repeats included, hashed by XXH64 with seed 42. A bit is set if it is set
    in over half of the hashes. A text with fewer words has one shingle, one
    without words (or null) the fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], "<u8")
    counts = np.zeros(64, "i8")
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="i8")
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, text_key, fp): every document's fingerprint as a signed 64-bit
    number, and the hash of its text as it is."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view("i8"))], ["id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(hashed), "id long, text_key long, fp long")


def _blocks(n: int, bits: int) -> list[int]:
    """Bit masks of the grid's tables: as few tables as keep cells of random
    fingerprints below about 64 rows. Any choice finds every pair."""
    for g in (bits + 2, bits + 3, bits + 4, bits + 6, bits + 8):
        if n <= 64 * 2 ** (1.415 * 32 / g * (g - bits)):
            break
    cuts = [round(32 * i / g) for i in range(g + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(masks, g - bits)]


def _counts_in_unary(fp: np.ndarray) -> np.ndarray:
    """Each two-bit segment's count as so many set bits: the bits that differ
    between two of these are the Manhattan distance of the counts."""
    both, low = np.uint64(_PAIRS), fp >> np.uint64(1)
    return ((fp | low) & both) | ((fp & low & both) << np.uint64(1))


def _linked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within cells, from rows sorted by cell and the rest's bit count.

    Keeps the rows of the last cell whose count can still meet later ones. Of
    the links of a cell it emits a spanning forest for each batch, so a cell
    of n fingerprints gives no more than n of them.
    """
    kept = np.zeros((0, 4), "i8")
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        rows, old = np.concatenate([kept, new]), len(kept)
        cell = np.concatenate([[0], np.cumsum((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))])
        rest, fp = rows[:, 2], np.ascontiguousarray(rows[:, 3]).view("u8")
        place = _counts_in_unary(fp)
        root = np.arange(len(rows))
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        active, shift = np.arange(len(rows)), 1
        while len(active := active[active + shift < len(rows)]):
            other = active + shift
            near = (cell[active] == cell[other]) & (rest[other] - rest[active] <= bits)
            active, other = active[near], other[near]
            fresh = other >= old
            a, b = active[fresh], other[fresh]
            for grid in (place, fp):
                close = np.bitwise_count(grid[a] ^ grid[b]) <= bits
                a, b = a[close], b[close]
            if len(a):
                apart = root[a] != root[b]
                joined = False
                for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                    p, q = find(x), find(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((x, y))
                        joined = True
                if joined:
                    while (up := root[root]).tolist() != root.tolist():
                        root = up
            shift += 1
        at = np.array(out, "i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[at[:, k], 3]) for k in (0, 1)], ["u", "v"])
        kept = rows[(cell == cell[-1]) & (rest >= rest[-1] - bits)]


def links(distinct: DataFrame, n: int, bits: int) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within ``bits`` bits.

    ``distinct`` has one row a fingerprint (column fp), ``n`` in all. Not all
    pairs are returned, but every pair within ``bits`` is connected.
    """
    fp = F.col("fp")
    # Two-bit counts never carry into the next segment, but the sum may pass the sign bit: it is made without overflow.
    high = F.shiftrightunsigned(fp, 62)
    low = fp.bitwiseAND(F.lit((1 << 62) - 1))
    low = low.bitwiseAND(F.lit(_PAIRS)) + F.shiftrightunsigned(low, 1).bitwiseAND(F.lit(_PAIRS))
    counts = low.bitwiseOR(F.shiftleft(F.bit_count(high).cast("long"), 62))
    every = (1 << 64) - 1
    tables = [F.struct(F.lit(i).alias("table"), F.lit(_signed(m)).cast("long").alias("mask"), F.lit(_signed(~m & every)).cast("long").alias("others")) for i, m in enumerate(_blocks(n, bits))]
    placed = distinct.select("fp", counts.alias("counts"), F.explode(F.array(*tables)).alias("t")).select(
        F.col("t.table").cast("long").alias("table"),
        F.col("counts").bitwiseAND(F.col("t.mask")).alias("cell"),
        F.bit_count(fp.bitwiseAND(F.col("t.others"))).cast("long").alias("rest"),
        "fp",
    )
    placed = stage(placed, "cells")
    # At most so many rows as the fingerprints' number over a cell's, so that the join below may broadcast them or not.
    hot = placed.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("table", "cell")
    dealt = placed.join(hot, ["table", "cell"], "left_anti").repartition("table", "cell").sortWithinPartitions("table", "cell", "rest", "fp")
    out = dealt.mapInArrow(tidied(lambda batches: _linked(batches, bits)), "u long, v long")
    crowded = placed.join(hot, ["table", "cell"], "left_semi").select("fp").distinct()
    return out if crowded.isEmpty() else out.unionByName(_met_around(crowded, bits))


def _around(radius: int) -> list[int]:
    return [sum(1 << b for b in some) for n in range(radius + 1) for some in combinations(range(64), n)]


def _met_around(fps: DataFrame, bits: int) -> DataFrame:
    """Edges that connect all of these fingerprints within ``bits`` bits.

    Of two such fingerprints one is within half of ``bits``, rounded up, and
    the other within half of it, rounded down, of some point. Every point
    links all that it is near to the least of the nearer ones, which is
    within ``bits`` of each of them. The rows grow in proportion to the
    fingerprints, and combine by point before they are shuffled.
    """
    near, far = bits // 2, bits - bits // 2
    masks = np.array(_around(far), "u8").view("i8")
    inner = len(_around(near))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                fp = batch.column(0).slice(i, 64).to_numpy()
                at = (fp[:, None] ^ masks).ravel()
                inside = np.tile(np.arange(len(masks)) < inner, len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(fp, len(masks))), pa.array(inside)], ["at", "fp", "inside"])

    met = fps.mapInArrow(tidied(points), "at long, fp long, inside boolean")
    least = met.groupBy("at").agg(F.min(F.when(F.col("inside"), F.col("fp"))).alias("v"), F.count(F.lit(1)).alias("n"))
    least = least.where("v IS NOT NULL AND n > 1").select("at", "v")
    return met.join(least, "at").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, bits: int = 4
) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most ``bits`` bits;
    component_id is the least id that links reach, the document itself
    included. Equal fingerprints are one node of the graph, however many
    documents share them. A null text is an empty one; texts without words
    share the fingerprint zero and link like any other. A null id never
    becomes a component_id unless all ids of its component are null; rows
    that repeat an id get a row each. An empty table gives no rows. Other
    columns are ignored.
    """
    return _labelled(docs, id_col, text_col, width, bits).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int = 4, bits: int = 4) -> DataFrame:
    """(id, text_key, fp, root, component_id) of every document."""
    prints = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    fps = stage(prints.select("fp").distinct(), "classes")
    found = components(links(fps, fps.count(), bits))
    found = fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # Documents that share a fingerprint get its root, in parts like all that share a key.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    held = prints.groupBy("fp").agg(F.collect_set(salt).alias("salts")).select("fp", F.explode("salts").alias("salt"))
    labels = found.join(held, "fp")
    rooted = prints.withColumn("salt", salt).join(labels, ["fp", "salt"]).select("id", "text_key", "fp", "root")
    return with_totals(rooted, ["root"], [F.min("id").alias("component_id")], "fp")


def keep_one(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each component, with the columns of ``docs``.

    ``labelled`` has (id, text_key, component) for every row of ``docs``;
    text_key is ``F.xxhash64`` of the text. Of a component the row with the
    least id stays, null last, then that with the least text_key. Rows that
    repeat both are one, with the least values of the other columns.
    """
    unknown = F.col("id").isNull()
    rank = F.struct(unknown.alias("unknown"), "id", "text_key")
    sets = labelled.groupBy("component", "id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_totals(sets, ["component"], [F.min(rank).alias("best")], "text_key").select("id", "text_key", "n", (rank == F.col("best")).alias("wins"))
    losing = ranked.where("n > 1 OR NOT wins").select(F.col("id").alias("__id"), F.col("text_key").alias("__text"))
    many = ranked.where("n > 1 AND wins").select(F.col("id").alias("__id"), F.col("text_key").alias("__text"))

    def same(keys: DataFrame):
        return [docs[id_col].eqNullSafe(keys["__id"]), F.xxhash64(docs[text_col]) == keys["__text"]]

    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.min(F.struct(F.lit(0), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)])).alias("__rest")
    one = docs.join(many, same(many), "left_semi").groupBy(docs[id_col], docs[text_col]).agg(rest)
    back = {c: F.col(f"__rest.c{i}").alias(c) for i, c in enumerate(others)}
    one = one.select(*[back.get(c, F.col(c)) for c in docs.columns])
    return docs.join(losing, same(losing), "left_anti").unionByName(one)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component: that with the least id.

    Ids that are null come last, and rows that repeat an id are told apart by
    their texts: of those with the least id only one stays.
    """
    found = _labelled(docs, id_col, text_col, **options)
    return keep_one(docs, found.select("id", "text_key", F.col("root").alias("component")), id_col, text_col)
