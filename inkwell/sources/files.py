"""Raw text files and small formats as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..types import struct_of, type_of

CODECS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "big5")
MOST_LOST, LEAST_SURE = 64, 0.5


def _detected(data: bytes) -> tuple[str | None, str | None]:
    """A guess by an optional library, or the reason why there is none."""
    try:
        import chardet
    except ImportError:
        return None, "no codec fits and no detector is installed"
    guess = chardet.detect(data)
    if not guess.get("encoding") or (guess.get("confidence") or 0) < LEAST_SURE:
        return None, f"no codec fits and the detector is unsure ({guess.get('encoding')}, {guess.get('confidence')})"
    return guess["encoding"], None


def decoded(data: bytes | None, codecs: tuple[str, ...] = CODECS) -> tuple[str | None, str | None, str | None, int]:
    """Text, encoding, error and replaced characters of a file's bytes.

    The first codec that fits wins; then a detector's guess; then the codec
    that loses the fewest characters, if those are few.
    """
    if data is None:
        return None, None, "file has no content", 0
    for codec in codecs:
        try:
            return data.decode(codec), codec, None, 0
        except UnicodeDecodeError:
            continue
    guess, why = _detected(data)
    if guess:
        try:
            return data.decode(guess), guess, None, 0
        except (UnicodeDecodeError, LookupError):
            why = f"the detected encoding {guess} does not fit"
    loose = [(data.decode(c, errors="replace"), c) for c in codecs]
    text, codec = min(loose, key=lambda x: x[0].count("�"))
    lost = text.count("�")
    if text.strip() and lost <= max(MOST_LOST, len(text) // 100_000):
        return text, codec, None, lost
    return None, None, why, 0


@F.pandas_udf(struct_of("text string, encoding string, error string, replacements int"))
def decode(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(c) for c in content], columns=["text", "encoding", "error", "replacements"])


@F.pandas_udf(type_of("string"))
def decode_as(content: pd.Series, encoding: pd.Series, replacements: pd.Series) -> pd.Series:
    """Text by a known encoding; strict unless characters were lost before."""
    if encoding.isna().any():
        raise ValueError("a file has no encoding")
    return pd.Series([c.decode(e, errors="replace" if n else "strict") for c, e, n in zip(content, encoding, replacements.fillna(0))])


def is_junk(name: Column) -> Column:
    return name.startswith(".") | (name == "Thumbs.db")


def text_files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """All text files below a folder: relative_path, absolute_path,
    file_size_bytes, text, encoding, error, replacements.

    A folder that does not exist or holds none gives no rows. Hidden files
    are left out; so are files that begin with an underscore, as anywhere in
    Spark.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        files = spark.createDataFrame([], schema)
        base = root.rstrip("/")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        base = system.getFileStatus(where).getPath().toString().rstrip("/")
    name = F.substring_index("path", "/", -1)
    rows = files.where(~is_junk(name)).select(
        F.substring("path", F.lit(len(base) + 2), F.length("path")).alias("relative_path"),
        F.regexp_replace("path", "^file:/*", "/").alias("absolute_path"),
        F.col("length").alias("file_size_bytes"),
        decode("content").alias("d"),
    )
    return rows.select("relative_path", "absolute_path", "file_size_bytes", "d.*")


def json_lines(spark: SparkSession, path: str, schema: StructType, *, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSONL file. Blank and broken lines are skipped, or, if
    columns are required, fail the query as does a row without them."""
    corrupt = "_corrupt"
    rows = spark.read.schema(StructType([*schema.fields]).add(corrupt, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)
    if not required:
        return rows.where(F.col(corrupt).isNull()).drop(corrupt)
    lacks = F.col(corrupt).isNotNull()
    for name in required:
        lacks = lacks | F.col(name).isNull()
    first = schema.fields[0]
    checked = F.when(lacks, F.raise_error(F.concat(F.lit(f"a line lacks {' or '.join(required)}: "), F.coalesce(corrupt, F.to_json(F.struct(*schema.names))))).cast(first.dataType))
    return rows.withColumn(first.name, checked.otherwise(F.col(first.name))).drop(corrupt)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; a byte order mark is no part of it."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])


def markdown_rows(spark: SparkSession, path: str, columns: tuple[str, ...] = ("query_id", "query", "wanted", "unwanted", "anchor_titles", "genre", "shape", "accepted"), mark: str = "✓") -> DataFrame:
    """Accepted rows of a table in a Markdown file; terms are lists."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c")).where(F.size("c") == len(columns))
    rows = rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])
    if "accepted" in columns:
        rows = rows.where(F.col("accepted") == mark).drop("accepted")
    lists = [c for c in ("wanted", "unwanted", "anchor_titles") if c in columns]
    return rows.withColumns({c: terms(F.col(c)) for c in lists})


def terms(cell: Column) -> Column:
    """A cell's terms; a dash or nothing is none."""
    return F.when(F.trim(cell).isin("—", "-", ""), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(cell, "、"), lambda x: F.trim(x)), lambda x: x != ""))
