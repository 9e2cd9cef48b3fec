from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import media, pictures, queries


def png(rows: np.ndarray, filters) -> bytes:
    """An 8-bit PNG whose rows use the filters in turn."""
    height, width, depth = rows.shape
    raw, before = b"", np.zeros(width * depth, int)
    for y in range(height):
        line = rows[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(depth, int), line[:-depth]])
        corner = np.concatenate([np.zeros(depth, int), before[:-depth]])
        kind = filters[y % len(filters)]
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [np.zeros_like(line), left, before, (left + before) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype("u1").tobytes()
        before = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_formats():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (9, 7, 1))
    assert np.array_equal(media.decode(png(grey, [0, 1, 2, 3, 4])), grey[:, :, 0])
    colour = rng.integers(0, 256, (6, 5, 3))
    assert np.allclose(media.decode(png(colour, [4, 3, 1])), colour @ [0.299, 0.587, 0.114], atol=1e-3)
    assert np.array_equal(media.decode(b"P5\n# note\n2 1\n255\n\x05\x06"), [[5, 6]])
    for broken in (None, b"", b"P5 9 9 255\n", b"GIF89a", b"P5", b"\x89PNG\r\n\x1a\n", png(grey, [0])[:-30]):
        assert media.decode(broken) is None
    for head in (b"P5 0 5 255\n", b"P5 5 0 255\n", b"P6 0 0 255\n", b"P5 99999999999 99999999999 255\n", b"P5 %s 1 255\n" % (b"9" * 5000), b"P5 60000 60000 255\n\x01"):
        assert media.decode(head) is None
    bomb = struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 0)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"0000"
    big = chunk(b"IDAT", zlib.compress(bytes(50_000_000)))
    assert media.decode(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bomb) + big).shape == (9, 9)
    huge = struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 0, 0, 0, 0)
    assert media.decode(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", huge) + big) is None


def test_resized_and_turned_copies(spark):
    df = vectors(spark, 30)
    kept = {r["media_id"]: media.decode(bytes(r["media"])) for r in pictures.images(df).collect()}
    ways = {"smaller": lambda x: pictures.resized(x, 0.9), "larger": lambda x: pictures.resized(x, 1.15), "turned": lambda x: pictures.turned(x, 10), "cropped": lambda x: x[20:-12, 16:-16]}
    data = [(100 * k + i, pictures.pgm(way(x))) for k, way in enumerate(ways.values()) for i, x in kept.items()]
    found = media.find_copies(spark.createDataFrame(data, "media_id long, media binary"), pictures.images(df)).where("kind = 'link'").collect()
    assert all(r["id"] % 100 == r["class_id"] for r in found)
    right = {name: sum(r["id"] // 100 == k for r in found) for k, name in enumerate(ways)}
    assert all(right[name] >= least for name, least in {"smaller": 18, "larger": 15, "turned": 10, "cropped": 25}.items()), right


def vectors(spark, n=60):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<float>")


def test_edited_copies_are_found_and_nothing_else(spark):
    df = vectors(spark)
    found = media.find_copies(pictures.images(df, edit=True), pictures.images(df)).where("kind = 'link'").collect()
    right = sum(r["id"] == r["class_id"] for r in found)
    assert right >= 0.9 * 60 and right == len(found)


def test_table_recall_against_brute_force(spark, sf):
    """Links by all pairs of descriptors, without tables, placed alike."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    links = {(r["id"], r["class_id"]) for r in queries.op8_media_copies(spark, sf).where("kind = 'link'").collect()}
    asked = [(r["media_id"], media.describe(media.decode(bytes(r["media"])))) for r in pictures.images(df.where("vec_id % 20 = 0"), edit=True).collect()]
    held = [(r["media_id"], media.describe(media.decode(bytes(r["media"])))) for r in pictures.images(df).collect()]
    want = set()
    for q, a in asked:
        for m, b in held:
            i, j = np.nonzero(np.bitwise_count(a["bits"][:, None] ^ b["bits"][None]).sum(-1) <= 32)
            turn = (b["turn"][j].astype(int) - a["turn"][i]) % media.TURNS
            scale = np.array(media.SCALES)
            ratio, angle = scale[a["level"][i]] / scale[b["level"][j]], turn * 2 * np.pi / media.TURNS
            left = b["x"][j] - ratio * (np.cos(angle) * a["x"][i] - np.sin(angle) * a["y"][i])
            top = b["y"][j] - ratio * (np.sin(angle) * a["x"][i] + np.cos(angle) * a["y"][i])
            votes = {}
            for dx in (0, 0.5):
                for dy in (0, 0.5):
                    for k, dt in ((k, dt) for k in range(len(i)) for dt in (0, 1)):
                        spot = ((turn[k] + dt) % media.TURNS, dt, round(ratio[k], 3), dx, dy, np.floor(left[k] / 12 + dx), np.floor(top[k] / 12 + dy))
                        votes.setdefault(spot, []).append((i[k], j[k]))
            if any(min(len({x for x, _ in v}), len({y for _, y in v})) >= 4 for v in votes.values()):
                want.add((q, m))
    assert len(links & want) >= 0.9 * len(want) and len(want) >= 0.8 * len(asked)


def test_hard_rows(spark):
    drawn = pictures.pgm(pictures.drawn(np.arange(8.0)))
    data = [(1, drawn), (2, drawn), (3, None), (4, None), (5, b""), (None, drawn), (6, b"junk"), (7, b"P5 2 2 255\n\x00\x00\x00\x00")]
    df = spark.createDataFrame(data, "media_id long, media binary").withColumns({n: F.lit(1) for n in ("id", "digest", "points", "class", "table")})
    out = media.find_copies(df, df).collect()
    classes = {(r["kind"], r["id"]): r["class_id"] for r in out if r["kind"] != "link"}
    assert len([r for r in out if r["kind"] == "media"]) == 8
    assert classes["media", 2] == classes["media", None] == 1 and classes["query", 4] == classes["query", 5] == 3
    assert {(r["id"], r["class_id"]) for r in out if r["kind"] == "link"} == {(1, 1)}
    assert media.find_copies(df.where("media_id > 99"), df.where("media_id > 99")).count() == 0


def test_common_corners_make_few_rows(spark):
    """Images that share a corner with all others but no placement: what the
    join writes grows with the images, not with the pairs of their corners."""
    base = media.describe(media.decode(pictures.pgm(pictures.drawn(np.arange(8.0)))))
    mixed = [(k, np.concatenate([media.describe(pictures.drawn(np.arange(8.0) + k)), base[k % 3 : k % 3 + 3]]).tobytes()) for k in range(1, 41)]
    table = media.pa.table({"class": [k for k, _ in mixed], "points": [p for _, p in mixed]})
    links = media.pa.Table.from_batches(media._matched(table, table, 32, 12.0, 4)).to_pylist()
    assert {(r["id"], r["class_id"]) for r in links} == {(k, k) for k in range(1, 41)}
    df = vectors(spark, 80)
    found = media.find_copies(pictures.images(df, edit=True), pictures.images(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin [table" not in plan


def test_small_slices_give_the_same_links(monkeypatch):
    points = {k: media.describe(pictures.drawn(np.arange(8.0) + k)) for k in range(6)}
    table = media.pa.table({"class": list(points), "points": [p.tobytes() for p in points.values()]})
    whole = media.pa.Table.from_batches(media._matched(table, table, 60, 12.0, 1)).to_pylist()
    monkeypatch.setattr(media, "MET", 7)
    assert sorted(map(str, media.pa.Table.from_batches(media._matched(table, table, 60, 12.0, 1)).to_pylist())) == sorted(map(str, whole))
    assert len(whole) > 6
