"""Substring deduplication by Rabin-Karp hashes of every window of words.

Each window is hashed by a rolling polynomial. To count windows without
shuffling each of them as a row of its own, a window travels with its
minimizer: the least hash of the shorter windows inside it. Equal windows
have equal minimizers, and neighbouring windows mostly share one, so a run of
them is one row: the minimizer as key, the document, the start, and the
windows' hashes in binary. Per batch of documents only the first occurrence
of a window is sent; later ones repeat it whatever else there is.

Equal hashes only propose. Within a batch windows are compared word by word.
Across batches each proposed stretch and the one it repeats send their words,
which an aggregation compares; where any differ, the windows of that stretch
are grouped by their words instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import with_totals
from .staging import give_back, stage
from .workers import tidied

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
#: Bytes of a window's hash that travel beside the 8 of its minimizer.
_BYTES = 6
_BLOCK = 1 << 21
#: Stretches are cut at multiples of so many windows of what they repeat, so
#: that the copies of a text send few different ones.
_CELL = 64
#: Rows of one minimizer that a task holds before it forgets repeated windows;
#: or twice the rows that were left the last time, if those are more.
_HELD = 20_000
_NULL = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` words, modulo 2**64.

    The prefix sums of word times base to the position give every window by
    a subtraction; times the base's inverse power, they no longer depend on
    the position.
    """
    n = len(words)
    inverse = pow(_BASE, -1, 1 << 64)
    powers = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _BASE, "u8")]), dtype="u8")
    back = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, inverse, "u8")]), dtype="u8")
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(words * powers[:n], dtype="u8")])
    return (sums[width:] - sums[:-width]) * back[: n - width + 1]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every window of ``width`` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words (equal words have equal ones), the 64-bit hashes
    by number, and the number of words of each text."""
    from xxhash import xxh3_64_intdigest

    split = [_words(t) for t in texts]
    sizes = np.fromiter(map(len, split), "i8", len(split))
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for s in split for w in s), "i8", int(sizes.sum()))
    return numbers, np.fromiter(map(xxh3_64_intdigest, known), "u8", len(known)), sizes


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _runs(ids: np.ndarray, texts: list[str | None], window: int, inner: int, width: int) -> pa.RecordBatch:
    """Runs of windows that start here first in this block, by minimizer, and
    runs of windows that repeat one of the block (without hashes)."""
    numbers, hashes, sizes = _numbered(texts)
    ends = np.cumsum(sizes)
    first = ends - sizes
    if len(numbers) < window:
        return _batch(*[np.zeros(0, "i8")] * 5, np.zeros(0, "u1"), width)
    words = hashes[numbers]
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = len(words) - window + 1
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])  # windows that stay within their document
    whole = _mixed(_rolled(words, window))[start] & np.uint64((1 << 8 * width) - 1)
    key = _least(_mixed(_rolled(words, inner)), window - inner + 1)[:n][start]
    place = start - first[doc[start]]
    own = doc[start]
    # Among equal windows of the block those at the least (id, place) are sent.
    order = np.lexsort((place, ids[own], whole, key))
    head = np.ones(len(order), bool)
    head[1:] = (whole[order][1:] != whole[order][:-1]) | (key[order][1:] != key[order][:-1])
    lead = np.empty(len(order), "i8")
    lead[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    repeats = (ids[own] != ids[own[lead]]) | (place != place[lead])
    for i in range(window):
        asked = np.flatnonzero(repeats)
        repeats[asked] = numbers[start[asked] + i] == numbers[start[lead[asked]] + i]
    key = np.where(repeats, 0, key)
    # A run ends where the document, the minimizer or the kind changes.
    cut = np.ones(len(own), bool)
    cut[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1]) | (repeats[1:] != repeats[:-1])
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, len(own)))
    carried = np.where(repeats[at], 0, length)
    # Repeats need no key; a hash of the document spreads them.
    spread = _mixed(ids[own[at]].view("u8") + np.uint64(1))
    data = _packed(whole[~repeats], width)
    return _batch(np.where(repeats[at], spread, key[at]).view("i8"), ids[own[at]], place[at], length, carried, data, width)


def _packed(whole: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(whole.astype("<u8").view("u1").reshape(-1, 8)[:, :width]).reshape(-1)


def _batch(key, doc, start, length, carried, data, width) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(carried * width)]).astype("i4")
    hashes = pa.BinaryArray.from_buffers(pa.binary(), len(carried), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    columns = [pa.array(key), pa.array(doc), pa.array(start.astype("i4")), pa.array(length.astype("i4")), hashes]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc", "start", "length", "hashes"])


def _proposed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Stretches (doc, start, length, lead_doc, lead_start) of windows whose
    hashes repeat those at the lead, from runs sorted by key, document and
    start. The lead is the first of its hash; it is null where a batch of
    documents has shown the repetition already."""
    held: list[pa.RecordBatch] = []
    most = _HELD
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        # The last key of a batch may go on in the next one.
        last = int(np.searchsorted(keys, keys[-1]))
        goes_on = bool(held) and held[-1].column(0)[0].as_py() == keys[0]
        if held and not (goes_on and last == 0):
            found, _ = _compared([*held, batch.slice(0, last)] if goes_on else held, width)
            yield found
            if not goes_on and last:
                yield _compared([batch.slice(0, last)], width)[0]
            held, most = [batch.slice(last)], _HELD
        elif held:
            held.append(batch)
        else:
            if last:
                yield _compared([batch.slice(0, last)], width)[0]
            held = [batch.slice(last)]
        if len(held) > 1 and sum(b.num_rows for b in held) > most:
            # Rows come by document and start, so later ones can only repeat.
            found, leads = _compared(held, width)
            yield found
            held, most = [leads], max(_HELD, 2 * leads.num_rows)
    if held:
        yield _compared(held, width)[0]


def _compared(batches: list[pa.RecordBatch], width: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The stretches, and the runs that are left without them."""
    table = pa.Table.from_batches(batches).combine_chunks()
    key, doc, start, length = (table.column(i).to_numpy() for i in range(4))
    start, length = start.astype("i8"), length.astype("i8")
    column = table.column(4).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    raw = np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]].reshape(-1, width)
    count = np.diff(offsets) // width
    whole = np.zeros((len(raw), 8), "u1")
    whole[:, :width] = raw
    whole = whole.view("<u8").reshape(-1)
    run = np.repeat(np.arange(len(count)), count)
    place = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at_doc = doc[run]
    order = np.lexsort((place, at_doc, whole, key[run]))
    k, w = key[run][order], whole[order]
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    lead = np.empty(len(order), "i8")
    lead[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
    later = (at_doc != at_doc[lead]) | (place != place[lead])
    # Neighbours of a run that repeat neighbours are one stretch.
    cut = later.copy()
    cut[1:] &= ~(later[:-1] & (run[1:] == run[:-1]) & (at_doc[lead][1:] == at_doc[lead][:-1]) & (place[lead][1:] == place[lead][:-1] + 1))
    at = np.flatnonzero(cut)
    size = np.bincount(np.cumsum(cut)[later] - 1, minlength=len(at)) if len(at) else np.zeros(0, "i8")
    known = count == 0
    none = np.zeros(int(known.sum()), "i8")
    without = np.concatenate([np.zeros(len(at), bool), np.ones(len(none), bool)])
    found = pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([at_doc[at], doc[known]])),
            pa.array(np.concatenate([place[at], start[known]])),
            pa.array(np.concatenate([size.astype("i8"), length[known]])),
            pa.array(np.concatenate([at_doc[lead[at]], none]), mask=without),
            pa.array(np.concatenate([place[lead[at]], none]), mask=without),
        ],
        ["doc", "start", "length", "lead_doc", "lead_start"],
    )
    left = np.flatnonzero(~later)
    ones = np.ones(len(left), "i8")
    return found, _batch(key[run[left]], at_doc[left], place[left], ones, ones, _packed(whole[left], width), width)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring stretches as one, cut at the lead's multiples of _CELL.
    Rows come sorted by document, lead, distance of the starts, and start."""
    for batch in batches:
        known = batch.filter(batch.column(3).is_null())
        yield known
        rest = batch.filter(batch.column(3).is_valid())
        if not rest.num_rows:
            continue
        doc, start, length, lead, lead_start = (rest.column(i).to_numpy() for i in range(5))
        new = np.ones(len(doc), bool)
        new[1:] = (
            (doc[1:] != doc[:-1]) | (lead[1:] != lead[:-1]) | (start[1:] - lead_start[1:] != start[:-1] - lead_start[:-1]) | (start[1:] != (start + length)[:-1])
        )
        at = np.flatnonzero(new)
        size = np.add.reduceat(length, at)
        begin, end = lead_start[at], lead_start[at] + size
        cells = (end - 1) // _CELL - begin // _CELL + 1
        of = np.repeat(np.arange(len(at)), cells)
        cell = (begin // _CELL)[of] + np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        low, high = np.maximum(begin[of], cell * _CELL), np.minimum(end[of], (cell + 1) * _CELL)
        columns = [doc[at][of], start[at][of] + low - begin[of], high - low, lead[at][of], low]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], batch.schema.names)


_LEAD = ["lead_doc", "lead_start", "length"]


def _texts_of(places: DataFrame, rows: DataFrame, window: int, single: bool) -> DataFrame:
    """The words at ``places`` (doc, at and any columns of longs): of the whole
    stretch, or (``single``) of each of its windows, with their doc and at.
    Texts that end before it have none."""
    names = places.columns
    at_i, length_i = names.index("at"), names.index("length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for i in range(batch.num_rows):
                words = _words(batch.column(0)[i].as_py())
                for place in batch.column(1)[i].as_py():
                    values = [place[c] for c in names]
                    at, length = values[at_i], values[length_i]
                    if at + length + window - 1 > len(words):
                        continue
                    parts = ((at + j, 1) for j in range(length)) if single else ((at, length),)
                    for a, n in parts:
                        values[at_i] = a
                        found.append((*values, b" ".join(words[a : a + n + window - 1])))
                        size += len(found[-1][-1])
                    if size > _BLOCK:
                        yield made(found)
                        found, size = [], 0
            if found:
                yield made(found)

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], [*names, "words"])

    lists = places.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("places"))
    schema = ", ".join(f"{c} long" for c in names) + ", words binary"
    return rows.join(lists, "doc").select("text", "places").mapInArrow(tidied(read), schema)


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, inner: int = 8, width: int = _BYTES
) -> DataFrame:
    """Stretches (doc, start, length) of windows whose words also start earlier.

    ``inner`` is the length of the minimizers' windows and ``width`` the bytes
    of a window's hash that are sent; both affect speed only. The result rests
    on tables in the shared folder.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            at, size = 0, 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if size >= _BLOCK or i + 1 == batch.num_rows:
                    yield _runs(ids[at : i + 1], texts.slice(at, i + 1 - at).to_pylist(), window, inner, width)
                    at, size = i + 1, 0

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _proposed(batches, width)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), F.col(text_col).alias("text"))
    runs = rows.mapInArrow(tidied(sent), "key long, doc long, start int, length int, hashes binary")
    schema = "doc long, start long, length long, lead_doc long, lead_start long"
    found = runs.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(tidied(proposed), schema)
    found = stage(found, "proposed")
    give_back(docs.sparkSession)
    near = found.repartition("doc").sortWithinPartitions("doc", "lead_doc", F.col("start") - F.col("lead_start"), "start")
    found = stage(near.mapInArrow(tidied(_joined), schema), "stretches")

    asked = found.where("lead_doc is not null")
    places = asked.select("doc", F.col("start").alias("at"), *_LEAD, F.lit(0).cast("long").alias("leads"))
    leads = asked.select(*_LEAD).distinct()
    places = places.union(leads.select(F.col("lead_doc").alias("doc"), F.col("lead_start").alias("at"), *_LEAD, F.lit(1).cast("long")))
    seen = _texts_of(places, rows, window, single=False).groupBy(*_LEAD, "words").agg(F.max("leads").alias("leads"))
    wrong = stage(seen.where("leads = 0").select(*_LEAD).distinct(), "unequal")
    give_back(docs.sparkSession)
    if wrong.isEmpty():
        return found.select("doc", "start", "length")
    windows = _texts_of(places.join(wrong, _LEAD, "left_semi").select("doc", "at", "length"), rows, window, single=True)
    windows = with_totals(windows, ["words"], [F.min(F.struct("doc", "at")).alias("first")], "doc")
    later = windows.where(F.struct("doc", "at") != F.col("first")).select("doc", F.col("at").alias("start"), F.lit(1).cast("long").alias("length"))
    right = found.join(wrong, _LEAD, "left_anti").select("doc", "start", "length")
    return right.union(later.distinct())


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, inner: int = 8, width: int = _BYTES
) -> DataFrame:
    """One row a document: id, n_words, n_removed, removed (maximal intervals
    of removed words as [start, end)), kept_text, kept_sha256.

    A word goes if a window that covers it also starts earlier: in a smaller
    id, or earlier in the same document. Windows are judged on the input, not
    on what is left. A null text has no words; texts with fewer words than a
    window lose none. A null id ranks below all others. Rows that repeat an
    id count as the same place, so copies among them are not "earlier"; what
    one of them loses at a place, the others lose there too. An empty table
    gives no rows; other columns are ignored.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words(text)
                drop = np.zeros(len(words) + 1, "i8")
                for x in gone or ():
                    a, b = x["start"], x["start"] + x["length"] + window - 1
                    if a < len(words):
                        drop[a] += 1
                        drop[min(b, len(words))] -= 1
                off = np.concatenate([[False], np.cumsum(drop[:-1]) > 0, [False]])
                edges = np.flatnonzero(off[1:] != off[:-1]).reshape(-1, 2).tolist()
                at, left = 0, []
                for a, b in edges:
                    left += words[at:a]
                    at = b
                whole = b" ".join(left + words[at:])
                spans = [{"start": a, "end": b} for a, b in edges]
                rows.append((doc_id, len(words), sum(b - a for a, b in edges), spans, whole, hashlib.sha256(whole).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
            names = ["id", "n_words", "n_removed", "removed", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    gone = repeated_windows(docs, id_col, text_col, window=window, inner=inner, width=width)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = rows.withColumn("doc", F.coalesce("id", F.lit(_NULL))).join(gone, "doc", "left").select("id", "text", "gone")
    schema = "id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept binary, kept_sha256 string"
    return joined.mapInArrow(tidied(kept), schema).select(
        F.col("id").alias(id_col), "n_words", "n_removed", "removed", F.col("kept").cast("string").alias("kept_text"), "kept_sha256"
    )
