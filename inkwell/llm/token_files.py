r"""Token ids as length-delimited binary records, with an offset index.

A record is framed as::

    8 bytes  length of the payload, little-endian
    4 bytes  masked CRC-32 of those 8 bytes
    payload  8 bytes document id, 1 byte "id is null", 1 byte width (2 or 4), then the ids
    4 bytes  masked CRC-32 of the payload
    1 byte   line feed

A masked checksum is the CRC rotated right by 15 bits plus 0xa282ead8, so
that a checksum over data that holds checksums stays sound. The files are
written by Spark's own text writer, whose line end is the last byte of a
frame: they get its commit protocol and go wherever Hadoop paths go. They are
read back with the binaryFile source, each as a whole, so their number grows
with the texts. The offset index lies beside them, in ``PATH.index``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage
from .tokens import encoder, vocabulary_path
from .workers import slices, tidied

_HEAD = struct.Struct("<QI")
_DOC = struct.Struct("<q?B")
#: Bytes of text for each file, on the average.
FILE = 64 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record, without its line feed; ``ids`` are 32-bit."""
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = _DOC.pack(doc_id or 0, doc_id is None, width) + body
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(content: bytes) -> Iterator[tuple[int, int, int | None, bytes]]:
    """Offset, bytes, document id and 32-bit ids of each record of a file."""
    at, view = 0, memoryview(content)
    while at < len(view):
        length, check = _HEAD.unpack_from(view, at)
        if masked(bytes(view[at : at + 8])) != check:
            raise ValueError(f"damaged length at byte {at}")
        payload = view[at + 12 : at + 12 + length]
        if masked(payload) != struct.unpack_from("<I", view, at + 12 + length)[0]:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, null, width = _DOC.unpack_from(payload)
        ids = bytes(payload[_DOC.size :])
        ids = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        yield at, length + 17, None if null else doc_id, ids
        at += length + 17


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 2,
    width: int = 2,
    file_bytes: int = FILE,
) -> None:
    """Writes the ids of every whole text to files in ascending id order, and
    their offset index (``index_of``) beside them.

    A null text counts as empty and gives the end id alone; a null id sorts
    first. Rows that repeat an id sort by the hash of their texts and give a
    record each. An empty table gives no records. Texts, not ids, are
    shuffled; ``width`` is 2 bytes for vocabularies below 65,536 ids, else 4.
    There is a file for each ``file_bytes`` of text at least.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary_path(vocabulary), end_id)
        for some in slices(batches):
            ids = known.encode(some.column(1).to_pylist())
            rows = [frame(d, x, width) for d, x in zip(some.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["id", "h"]
    files = -(-size // file_bytes)
    # Up to as many files as the session's shuffles have partitions, the engine balances them itself.
    enough = files <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(*order) if enough else rows.repartitionByRange(files, *order)
    ordered = ordered.sortWithinPartitions(*order, "text").select("id", "text")
    ordered.mapInArrow(tidied(encoded), "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(path)
    _indexed(docs.sparkSession, path).write.parquet(f"{path}.index")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of the files, as a table.

    One row a record: file, offset, n_bytes, doc_id, start (ids in all records
    before it), n_tokens, ids_crc32.
    """
    return spark.read.parquet(f"{path}.index")


def file_number(name: Column) -> Column:
    """The place of a file among those of one write. Names alone would not
    sort, as their numbers get longer from the hundred-thousandth file on."""
    return F.regexp_extract(name, r"part-(\d+)[^/]*$", 1).cast("long")


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    """The index, from the files themselves; every checksum is verified."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "n_bytes", "doc_id", "local_start", "n_tokens", "ids_crc32"]
        kinds = [pa.string(), *[pa.int64()] * 6]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, start = [], 0
                for offset, size, doc_id, ids in frames(content.as_buffer()):
                    rows.append((name.as_py(), offset, size, doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(
        tidied(indexed), "file string, offset long, n_bytes long, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    index = stage(found, "token-index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(W.orderBy(file_number(F.col("file"))).rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return index.join(starts, "file").select(
        "file", "offset", "n_bytes", "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted`` (file, offset, n_bytes, place) points at.

    ``place`` is any number, such as a shuffled position; the result has
    doc_id, place and ids (array of integers) and is not sorted. A file's
    wanted offsets meet its content, so no file is read twice.
    """

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1), strict=True):
                view, rows = content.as_buffer(), []
                for x in at.as_py():
                    (_, _, doc_id, ids), *_ = frames(view.slice(x["offset"], x["n_bytes"]))
                    rows.append((doc_id, x["place"], np.frombuffer(ids, "<u4").astype("i4")))
                ids = pa.array([r[2] for r in rows], pa.list_(pa.int32()))
                ends = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ends, ids], ["doc_id", "place", "ids"])

    at = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "n_bytes", "place")).alias("at"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.join(at, "file").select("content", "at").mapInArrow(tidied(picked), "doc_id long, place long, ids array<int>")
