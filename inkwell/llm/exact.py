"""Exact deduplication by skew-safe combining.

Rows first combine within their partition, then by digest and salt, then the
salts' winners combine by digest. Every stage groups by the digest and by the
whole text, so two texts that share a digest stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage

#: Salts by which the copies of one text are dealt out.
SALTS = 32


def _digest(text: Column) -> Column:
    # Never null, which keeps the engine from hashing again for a filter on nulls.
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(salts))


def _combined(rows: DataFrame, carried: Column | None, salts: int) -> DataFrame:
    """One row a distinct text: digest, text, win (the winner's id, with its
    other columns if ``carried`` names them), n, and salts that occur."""
    win = F.max("id") if carried is None else F.max(F.struct("id", carried.alias("rest")))
    salted = (
        rows.withColumn("salt", _salt(salts))
        .groupBy("digest", "text", "salt")
        .agg(win.alias("win"), F.count(F.lit(1)).alias("n"))
    )
    top = F.max("win")
    # Dealt by digest alone, so that the count of texts of a digest needs no other shuffle.
    return salted.repartition("digest").groupBy("digest", "text").agg(
        top.alias("win"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")
    )


def label_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=_digest, salts: int = SALTS
) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as
    empty. A null id ranks below any other; if all ids of a group are null,
    keep_id is null and one of its rows is kept. Rows that repeat an id with
    the same text count one by one in group_size, and one of them is kept if
    the id is. An empty table gives no rows. Other columns are ignored.

    Texts are shuffled twice, after the copies within a partition have been
    combined; the way back to the documents carries digests alone, and meets
    them by digest and salt, so that a group's rows come back in as many
    tasks as its salts. Should one digest stand for several texts, its
    documents are joined by their texts instead.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    sha = F.lower(F.hex("digest")) if digest is _digest else F.sha2("text", 256)
    by_digest = stage(
        _combined(rows, None, salts).groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("win").alias("keep_id"), F.sum("n").alias("group_size"),
            F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts"),
        ),
        "digests",
    )
    narrow = rows.select("id", "digest", _salt(salts).alias("salt"), sha.alias("text_sha256"))
    dealt = by_digest.where("texts = 1").select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
    out = narrow.join(dealt, ["digest", "salt"])
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():
        both = rows.join(shared, "digest", "left_semi").withColumn("salt", _salt(salts))
        again = _combined(both.drop("salt"), None, salts).select(
            "digest", "text", F.explode("salts").alias("salt"), F.col("win").alias("keep_id"), F.col("n").alias("group_size")
        )
        whole = both.join(again, ["digest", "text", "salt"]).withColumn("text_sha256", F.sha2("text", 256))
        out = out.unionByName(whole.drop("text"))
    # Rows that repeat an id and text share a digest and a salt, by which they lie together already.
    nth = F.row_number().over(W.partitionBy("digest", "salt", "id", "text_sha256").orderBy(F.lit(1)))
    return out.withColumn("nth", nth).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=_digest, salts: int = SALTS
) -> DataFrame:
    """The documents that stay, with the columns of ``docs``.

    One row stays for each distinct text, also where rows repeat an id. The
    winner's other columns travel with it, so nothing is joined back.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    carried = F.struct(
        F.col(text_col).isNull().alias("was_null"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]
    )
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("rest")
    )
    rows = rows.withColumn("digest", digest(F.col("text")))
    won = _combined(rows, F.col("rest"), salts)
    back = {c: F.col(f"win.rest.c{i}") for i, c in enumerate(others)}
    back[id_col] = F.col("win.id")
    back[text_col] = F.when(~F.col("win.rest.was_null"), F.col("text"))
    return won.select(*[back[c].alias(c) for c in docs.columns])
