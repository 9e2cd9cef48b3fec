"""Near duplicates by SimHash, verified by the exact Jaccard similarity of
word shingles.

The sets' SimHashes propose pairs within a few differing bits, by the grid of
``simhash``. Those bits are a similarity of about 0.95, and as many as 0.8
needs leave no grid that selects. So MinHash bands propose pairs too: two
sets of similarity 0.8 share none of 32 bands of five minima with a
probability of 3 in a million, more similar ones more rarely. Every pair that
either proposes is verified on the whole sets, unless other pairs have linked
its two sets already.

Sets that fingerprints or bands connect form a group. A group is cut into blocks, which are
linked one by one. One set of each part that a block falls into, the most
central one, is dealt into blocks again, each with the same few central sets
of the group, so that the copies of one text come together in a time that
grows with their number. What is then still of several components in a group
is compared pair by pair where it can link at all: a set shares with others
no more than its shingles that other components have too. This is exact, and
leaves few pairs, however many copies lie just beyond the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import keep_one, links
from .skew import with_totals
from .staging import give_back, stage
from .workers import slices, tidied

BANDS, ROWS = 32, 5
#: About as many sets has a block.
BLOCK = 256
#: Central sets of a group that every block of the second round has.
CENTRES = 8
#: Sets that a set may meet by shingles rather than by its size.
LIGHT = 256
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 2**32, BANDS * ROWS, "u4")
_TIMES = _RNG.integers(0, 2**32, BANDS * ROWS, "u4") | np.uint32(1)
_MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), "u8") | np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles.

    A-Z are lower-cased; shingles are ``width`` words. A text with fewer
    words has one shingle, one without words (or null) none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    known = {w: xxh64_intdigest(w, 42) for w in set(words)}
    each = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, "u8")
    for i in range(width):
        out = (out ^ each[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band; sets that agree in a band's minima share it."""
    least = np.full(BANDS * ROWS, 2**32 - 1, "u4")
    short = (shingles >> np.uint64(32)).astype("u4")
    for i in range(0, len(short), 512):
        np.minimum(least, ((short[i : i + 512, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS).astype("u8") * _MIX).sum(axis=1, dtype="u8")


def fingerprint_of(shingles: np.ndarray) -> int:
    """The SimHash of a set, as a signed 64-bit number: a bit is set if it is
    set in over half of the hashes; zero for none."""
    counts = np.zeros(64, "i8")
    for i in range(0, len(shingles), 1 << 16):
        bits = np.unpackbits(shingles[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="i8")
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def node_of(shingles: np.ndarray) -> int:
    """One number for equal sets, as a signed 64-bit hash; zero for none."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(shingles.tobytes(), 7) if len(shingles) else 0
    return x - (1 << 64) if x >> 63 else x


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``percent`` %."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, text_key, node, fp, bands) of every document; equal sets have one node."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            node = pa.array([node_of(s) for s in sets], pa.int64())
            fp = pa.array([fingerprint_of(s) for s in sets], pa.int64())
            bands = pa.array([band_keys(s).view("i8") for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, fp, bands], ["id", "text_key", "node", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidied(hashed), "id long, text_key long, node long, fp long, bands array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, group, size, shingles, keys)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            held, keys = (pa.array([x.view("i8") for x in some], pa.list_(pa.int64())) for some in (sets, map(band_keys, sets)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), held, keys], ["node", "group", "size", "shingles", "keys"])

    return texts.mapInArrow(tidied(made), "node long, group long, size long, shingles array<long>, keys array<long>")


def linked(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The sets of a block with the least one that links reach (root), and
    whether they are the most central of those with their root (mid): all
    pairs that share a band and are at least ``percent`` % similar link.
    ``weight`` tells how often others have a set's keys."""
    rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
    sets = [np.asarray(s, "i8").view("u8") for s in rows["shingles"]]
    keys = np.array(rows["keys"].tolist(), "i8")
    sizes, root = rows["size"].to_numpy(), np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets) - 1):
        able = (keys[i + 1 :] == keys[i]).any(axis=1)
        able &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        for j in (np.flatnonzero(able) + i + 1).tolist():
            p, q = find(i), find(j)
            if p != q and similar(sets[i], sets[j], percent):
                root[max(p, q)] = min(p, q)
    top = np.array([find(i) for i in range(len(sets))])
    weight = np.zeros(len(sets), "i8")
    for band in keys.T:
        _, at, n = np.unique(band, return_inverse=True, return_counts=True)
        weight += n[at]
    order = np.lexsort((np.arange(len(top)), -weight, top))
    mid = np.zeros(len(top), bool)
    mid[order[np.append(True, np.diff(top[order]) != 0)]] = True
    node = rows["node"].to_numpy()
    return pd.DataFrame({"node": node, "group": rows["group"], "root": node[top], "mid": mid, "weight": weight, "blocks": rows["blocks"]})


def _rounds(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between similar sets, from two rounds of blocks."""
    kind = "node long, group long, root long, mid boolean, weight long, blocks long"

    def run(dealt: DataFrame, name: str) -> DataFrame:
        met = sets.join(dealt, "node").groupBy("group", "block").applyInPandas(lambda rows: linked(rows, percent), kind)
        return stage(met, name)

    def blocks(nodes: DataFrame, turn: int) -> DataFrame:
        sized = with_totals(nodes, ["group"], [F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")], "node")
        return sized.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")))

    first = run(blocks(sets.select("node", "group"), 0).drop("group"), "linked")
    again = blocks(first.where("mid AND blocks > 1").select("node", "group"), 1)
    centres = first.where("mid AND blocks > 1").groupBy("group", F.pmod(F.xxhash64("node"), F.lit(CENTRES)).alias("of")).agg(F.max_by("node", F.struct("weight", "node")).alias("node"))
    each = centres.join(again.groupBy("group").agg(F.max("blocks").alias("blocks")), "group")
    each = each.select("node", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    second = run(again.select("node", "blocks", "block").unionByName(each), "linked")
    return first.unionByName(second).where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def _meet(u: DataFrame, v: DataFrame, p: float, rule) -> DataFrame:
    """Pairs (u, v) of a group's sets, of sizes that each allows the other, in
    different components, not both of the largest one, that keep ``rule``.
    ``v`` is dealt into parts by classes of sizes of 2 %."""
    cell = ["group", "class", "main"]
    names = [F.col("node").alias("v"), F.col("component").alias("v_part"), F.col("size").alias("n"), F.col("most").alias("v_most")]
    v = v.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / np.log(1.02)).cast("long"))
    v = with_totals(v, cell, [F.ceil(F.count(F.lit(1)) / 1024).alias("parts")], "node")
    v = v.select(*cell, *names, F.col("odd").alias("v_odd"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "parts")
    there = v.select(*cell, "parts").distinct()
    lowest, highest = (F.floor(F.log(x) / np.log(1.02)).cast("long") for x in (F.col("size") * p, F.col("most")))
    others = F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    u = u.select("group", "main", F.explode(F.sequence(lowest - 1, highest + 1)).alias("class"), F.col("node").alias("u"), F.col("component").alias("u_part"), F.col("size").alias("m"), F.col("most").alias("u_most"))
    u = u.withColumn("main", F.explode(others))
    u = u.join(there, cell).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    fits = (F.col("n") <= F.col("u_most")) & (F.col("m") <= F.col("v_most")) & (F.col("u_part") != F.col("v_part"))
    return u.join(v, [*[u[c] == v[c] for c in (*cell, "part")], fits & rule]).select("u", "v")


def _left(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between all similar sets of a group that are not of one
    component yet; ``known`` has node, group, component.

    Sets of n and m shingles that are similar share at least the ``percent``
    part p of p / (1 + p) times n + m, and each of them has as many that also
    other components have. So a set can link only with sizes up to a bound of
    its own, and meets only these.

    A group's centre is what more than half of its sets have. Let x be the
    number of shingles that tell a set from it. Similar sets differ in at most
    q = (1 - p) / (1 + p) times n + m; a set is far if that is less than its x
    (with the centre's size for n). What a far set links with shares with it
    more than half of its own x, for sizes like the centre's (strong); a
    shingle that it alone has is none of these. A strong set no smaller than
    the centre has at most half of x in missing shingles, so it must share
    one that the centre lacks: where few sets have any of these (light), only
    they meet it. Other strong sets meet all far sets of a fitting size.
    Sets that are not far are mostly of the group's largest component; those
    that are not (odd) meet all sets of a fitting size.
    """
    part, p, yes, no = F.col("component"), percent / 100, 100 + percent, 100 - percent
    totals = [F.min(part).alias("low"), F.max(part).alias("high"), F.max(F.struct(F.xxhash64("node"), part)).alias("biggest"), F.count(F.lit(1)).alias("sets")]
    mixed = with_totals(known, ["group"], totals, "node").where("low != high")
    mixed = stage(mixed.select("node", "group", "component", (part == F.col("biggest.component")).alias("main"), "sets"), "mixed")
    rows = sets.drop("group", "keys").join(mixed, "node")
    each = rows.select("node", "group", "component", "size", "main", "sets", F.explode("shingles").alias("shingle"))
    totals = [F.min(part).alias("low"), F.max(part).alias("high"), F.count(F.lit(1)).alias("n"), F.min("node").alias("least")]
    held = with_totals(each, ["group", "shingle"], totals, "node")
    central = F.expr("2 * n > sets")
    foreign = F.expr("low != high AND 2 * n <= sets")
    held = held.groupBy("node", "group", "component", "size", "main").agg(
        F.count_if(F.expr("low != high")).alias("shared"),
        F.count_if(central).alias("common"),
        F.count_if(central & (F.col("node") == F.col("least"))).alias("firsts"),
        F.count_if(foreign).alias("foreign"),
        F.coalesce(F.sum(F.when(foreign, F.col("n"))), F.lit(0)).alias("met"),
        F.collect_list(F.when(foreign & (F.col("n") <= LIGHT), F.col("shingle"))).alias("rare"),
    )
    held = with_totals(stage(held, "held"), ["group"], [F.sum("firsts").alias("c")], "node")
    size, c = F.col("size"), F.col("c")
    x, told = size + c - 2 * F.col("common"), F.col("foreign") + c - F.col("common")
    held = held.withColumn("far", yes * x > no * (size + c)).withColumn("odd", ~F.col("far") & ~F.col("main"))
    held = held.withColumn("strong", 2 * yes * told > yes * x + no * (c - size))
    held = held.withColumn("weak", F.col("far") & (2 * yes * told >= yes * x - no * (size + c)))
    held = held.withColumn("light", (size >= c) & (F.col("met") <= LIGHT))
    # A little more than the bound, so that rounding loses none.
    most = F.col("shared") * ((1 + p) / p) - size + 1e-6
    able = held.withColumn("most", F.least(most, size / p + 1e-6)).where(F.col("most") >= size * p)
    able = stage(able, "able")
    odd = able.where("odd")
    pairs = _meet(able.where("weak"), able.where("strong AND NOT light AND NOT odd"), p, F.lit(True))
    beside = able.join(odd.select("group").distinct(), "group", "left_semi")
    pairs = pairs.unionByName(_meet(odd, beside, p, ~F.col("v_odd") | (F.col("u") < F.col("v"))))
    u = able.where("weak").select("group", F.explode("rare").alias("shingle"), F.col("node").alias("u"), F.col("component").alias("u_part"), F.col("size").alias("m"), F.col("most").alias("u_most"))
    v = able.where("strong AND light AND NOT odd").select("group", F.explode("rare").alias("shingle"), F.col("node").alias("v"), F.col("component").alias("v_part"), F.col("size").alias("n"), F.col("most").alias("v_most"))
    fits = (F.col("n") <= F.col("u_most")) & (F.col("m") <= F.col("v_most")) & (F.col("u_part") != F.col("v_part"))
    met = u.join(v, [u["group"] == v["group"], u["shingle"] == v["shingle"], fits]).select("u", "v")
    pairs = pairs.unionByName(met).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(x)) for n, x in (("u", "a"), ("v", "b")))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(x.values.to_numpy().view("u8"), y.values.to_numpy().view("u8"), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    whole = pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")
    return whole.mapInArrow(tidied(verified), "u long, v long")


def _alike(nodes: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) that connect all nodes whose fingerprints differ in at
    most ``bits`` bits."""
    classes = stage(nodes.groupBy("fp").agg(F.min("node").alias("least")), "classes")
    equal = with_totals(nodes.select("node", "fp"), ["fp"], [F.min("node").alias("least")], "node").where("node != least")
    a, b = (classes.select(F.col("fp").alias(u), F.col("least").alias(x)) for u, x in (("u", "a"), ("v", "b")))
    near = links(classes.select("fp"), classes.count(), bits).distinct().join(a, "u").join(b, "v")
    return equal.select(F.col("node").alias("u"), F.col("least").alias("v")).unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def similar_sets(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, width: int, percent: int, bits: int) -> DataFrame:
    """(node, root) of all nodes of ``found`` (the ``prints`` of ``docs``) that
    links reach: those that fingerprints or a band bring together and that are
    at least ``percent`` % similar."""
    nodes = found.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("at"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = stage(nodes, "nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = with_totals(keyed, ["band", "key"], [F.min("node").alias("least"), F.count(F.lit(1)).alias("n")], "node").where("n > 1")
    met = shared.where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    groups = components(met.unionByName(_alike(nodes, bits)))
    wanted = nodes.join(groups.withColumnRenamed("root", "group"), "node").select("node", "group", F.col("at.id").alias("__id"), F.col("at.text_key").alias("__text"))
    match = [docs[id_col].cast("long").eqNullSafe(wanted["__id"]), F.xxhash64(docs[text_col]) == wanted["__text"]]
    texts = docs.join(wanted, match).select(wanted["node"], wanted["group"], docs[text_col].cast("string").alias("text"))
    # Rows that repeat an id and text bring a node's set several times.
    sets = stage(_sets(texts, width).dropDuplicates(["node"]), "sets")
    give_back(docs.sparkSession)
    first = stage(components(_rounds(sets, percent)), "components")
    give_back(docs.sparkSession)
    known = sets.select("node", "group").join(first, "node", "left").select("node", "group", F.coalesce("root", "node").alias("component"))
    more = stage(_left(known, sets, percent), "left")
    # Those links are between components: their roots are the nodes of a smaller graph.
    part = first.select(F.col("node").alias("p"), "root")
    ends = more.join(part.withColumnRenamed("root", "a"), F.col("u") == F.col("p"), "left").drop("p").join(part.withColumnRenamed("root", "b"), F.col("v") == F.col("p"), "left")
    second = components(ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")))
    second = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = first.unionByName(second.select(F.col("root").alias("node"), "root").join(first.select("node"), "node", "left_anti"))
    return rooted.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, bits: int = 4
) -> DataFrame:
    """One row of ``docs`` for each component of similar documents.

    Documents link if the Jaccard similarity of their sets of ``width``-word
    shingles is at least ``percent`` %; texts without words (or null) are all
    alike. SimHashes of these sets within ``bits`` differing bits and MinHash
    bands propose the pairs. Of a component the row with the least id stays, a null id last,
    then that with the least hash of its text. Shingles are compared as
    64-bit hashes.
    """
    give_back(docs.sparkSession)
    found = stage(prints(docs, id_col, text_col, width), "prints")
    whole = similar_sets(docs, found, id_col, text_col, width, percent, bits)
    labelled = found.join(whole, "node", "left").select("id", "text_key", F.coalesce("root", "node").alias("component"))
    return keep_one(docs, labelled, id_col, text_col)
