"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, stage


#: Parts into which the neighbours of a node are dealt where they are joined.
SALTS = 8


def _least(edges: DataFrame) -> DataFrame:
    """(u, salt, m): the least neighbour of each u, a row for each part of its
    neighbours that there is. The neighbours of a node that very many share
    so come together in several tasks, and combine before they are shuffled.
    """
    parts = edges.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("salt").alias("salts"))
    return parts.select("u", "m", F.explode("salts").alias("salt"))


def _dealt(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def _star(edges: DataFrame) -> DataFrame:
    """Links each u's larger neighbours, and u itself where it is one of its
    smaller ones, to the least node that u knows."""
    both = _dealt(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = _least(both).select("u", "salt", F.least("u", "m").alias("m"))
    return both.join(least, ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _dealt(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = _least(down)
    moved = down.join(least, ["u", "salt"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the
    least node that it can reach. Nodes without edges are not returned.

    Every round shuffles the edges and writes them to the shared folder; only
    a checksum of them reaches the driver. The number of rounds grows with
    the logarithm of the nodes.
    """
    now, sums = stage(edges.where("u != v").select("u", "v").distinct(), "edges"), None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if found == sums or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        sums, before = found, now
        now = stage(_small_star(_star(now)), "edges")
        drop_staged(before)
