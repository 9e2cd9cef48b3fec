"""Finding cropped or edited copies of images by local descriptors.

An image is described at its strongest corners on a pyramid of scales. Each
corner's patch is turned to its intensity centroid and described by 256
comparisons of smoothed pixels. Both sides are dealt into parts, and each part
of one meets each part of the other in one task, so that only links leave it.
There descriptors meet in eight tables by 32 of their bits each, which finds all pairs within seven differing bits and, of
those that differ in d bits, about 1 - (1 - (7/8)**d)**8; pairs are verified on all bits, and
images match if enough of their pairs agree on one rotation, scale and shift.
The number of corners is a limit on recall: it grows with an image's area,
but an image that shows a small part of another shares few of them.

Equal images are one class: they are described once and compared once.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .workers import tidied

SCALES = (1.0, 0.75, 0.5)
#: Corners of each scale for every 96 x 96 pixels.
CORNERS, TILE = (16, 10, 6), 96 * 96
#: Tables in which descriptors meet.
TABLES = 8
#: Bytes of descriptors in a part, the least number of parts of the media, and
#: the descriptors with a common key that a task holds at once.
BLOCK, PARTS, MET = 1 << 23, 24, 1 << 20
TURNS = 24
_RADIUS, _BORDER, _STEP = 9, 13, 3.0
#: Pixels that an image may have; what claims more is not decoded.
PIXELS = 1 << 24
#: A described corner.
KIND = np.dtype([("x", "f4"), ("y", "f4"), ("level", "i1"), ("turn", "i1"), ("bits", "u1", 32)])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or of an 8-bit PNG without
    interlacing; None for anything else: damaged files, images without pixels,
    and those of more than ``PIXELS``, however small their file."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, OverflowError, struct.error, zlib.error):
        pass
    return None


def _sized(width: int, height: int) -> None:
    if not 0 < width * height <= PIXELS:
        raise ValueError("no pixels, or too many")


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype("f4")
    return pixels[:, :, :3].astype("f4") @ np.array([0.299, 0.587, 0.114], "f4")


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit() and end < at + 12:
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    if most > 255:
        raise ValueError("only 8 bits")
    _sized(width, height)
    depth = 3 if data[:2] == b"P6" else 1
    return _grey(np.frombuffer(data, "u1", width * height * depth, at + 1).reshape(height, width, depth))


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, bits, colour, _, _, interlaced = head or (0,) * 7
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if bits != 8 or depth is None or interlaced:
        raise ValueError("unsupported PNG")
    _sized(width, height)
    size = height * (width * depth + 1)
    raw = zlib.decompressobj().decompress(b"".join(body), size)  # no more than the image holds
    rows = np.frombuffer(raw, "u1", size).reshape(height, width * depth + 1)
    out = np.zeros((height + 1, width * depth + depth), "i4")  # a row and a pixel of zeros before the first
    for y, row in enumerate(rows):
        kind, line, up, now = row[0], row[1:].astype("i4"), out[y], out[y + 1]
        if kind == 0:
            now[depth:] = line
        elif kind == 2:
            now[depth:] = (line + up[depth:]) & 255
        else:
            for x in range(len(line)):
                a, b, c = now[x], up[x + depth], up[x]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x + depth] = (line[x] + guess) & 255
    return _grey(out[1:, depth:].reshape(height, width, depth))


def _box(image: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2r+1 pixels, the edge repeated."""
    padded = np.pad(image, ((r + 1, r), (r + 1, r)), mode="edge").astype("f8")
    sums = padded.cumsum(0).cumsum(1)
    n = 2 * r + 1
    return ((sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n]) / n**2).astype("f4")


def _resized(image: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return image
    image = _box(image, 1)
    height, width = (max(1, int(n * scale)) for n in image.shape)
    ys, xs = (np.minimum((np.arange(n) + 0.5) / scale - 0.5, m - 1.001).clip(0) for n, m in ((height, image.shape[0]), (width, image.shape[1])))
    y, x = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y)[:, None], xs - x
    y2, x2 = np.minimum(y + 1, image.shape[0] - 1), np.minimum(x + 1, image.shape[1] - 1)
    top = image[y][:, x] * (1 - fx) + image[y][:, x2] * fx
    low = image[y2][:, x] * (1 - fx) + image[y2][:, x2] * fx
    return top * (1 - fy) + low * fy


@functools.cache
def _pattern() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the 256 comparisons at each turn, and a disk's offsets."""
    rng = np.random.default_rng(11)
    points = rng.normal(0, 4.5, (4096, 2, 2))
    points = points[(np.hypot(points[..., 0], points[..., 1]) <= _RADIUS).all(axis=1)]
    points = points[np.hypot(*(points[:, 0] - points[:, 1]).T) >= 3][:256]
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], 1), np.stack([np.sin(angle), np.cos(angle)], 1)], 1)
    turned = np.einsum("tij,pkj->tpki", turn, points)
    grid = np.mgrid[-7:8, -7:8].reshape(2, -1)
    return np.rint(turned).astype("i4"), grid[:, np.hypot(*grid) <= 7]


def describe(image: np.ndarray | None) -> np.ndarray:
    """The descriptors of an image's corners: rows of x, y, scale level, turn
    and 32 bytes. Images without room for a patch have none."""
    if image is None:
        return np.zeros(0, KIND)
    pattern, disk = _pattern()
    found = []
    for level, (scale, most) in enumerate(zip(SCALES, CORNERS, strict=True)):
        layer = _resized(image, scale)
        height, width = layer.shape
        if min(height, width) <= 2 * _BORDER:
            continue
        smooth = _box(layer, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = corner
        for axis in (0, 1):
            peak = np.maximum.reduce([np.roll(peak, k, axis) for k in range(-3, 4)])
        inner = np.zeros(layer.shape, bool)
        inner[_BORDER:-_BORDER, _BORDER:-_BORDER] = True
        ys, xs = np.nonzero((corner == peak) & inner & (corner > 1.0))
        best = np.argsort(-corner[ys, xs], kind="stable")[: most * -(-image.size // TILE)]
        ys, xs = ys[best], xs[best]
        if not len(ys):
            continue
        patch = smooth[ys[:, None] + disk[0], xs[:, None] + disk[1]]
        angle = np.arctan2(patch @ disk[0], patch @ disk[1])
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        at = pattern[turn]  # corners x comparisons x 2 points x (x, y)
        blurred = _box(layer, 2)
        values = blurred[ys[:, None, None] + at[..., 1], xs[:, None, None] + at[..., 0]]
        rows = np.zeros(len(ys), KIND)
        rows["x"], rows["y"], rows["level"], rows["turn"] = xs / scale, ys / scale, level, turn
        rows["bits"] = np.packbits(values[..., 0] + _STEP < values[..., 1], axis=1, bitorder="little")
        found.append(rows)
    return np.concatenate(found) if found else np.zeros(0, KIND)


def described(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, digest, points): every row's image, its descriptors in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            digests, points = [], []
            for item in batch.column(1).to_pylist():
                digest = _digest(item)
                if digest not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[digest] = describe(decode(item)).tobytes()
                digests.append(digest)
                points.append(known[digest])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(points, pa.binary())], ["id", "digest", "points"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("m")).mapInArrow(tidied(run), "id long, digest binary, points binary")


def _digest(item: bytes | None) -> bytes:
    import hashlib

    return hashlib.sha256(item or b"").digest()


def _parts(classes: DataFrame, least: int) -> int:
    """So many parts hold about ``BLOCK`` bytes of descriptors each."""
    held = classes.agg(F.sum(F.length("points"))).first()[0] or 0
    return max(least, -(-held // BLOCK))


def _dealt(classes: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
    """The classes in parts (``own``), once for each part of the other side."""
    rows = classes.select(F.pmod(F.xxhash64("class"), F.lit(parts)).alias(own), "class", "points")
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _read(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The descriptors of a part's classes in order, their classes, and their
    number within the class."""
    classes, points = part.column("class").to_numpy(), part.column("points").to_pylist()
    order = np.argsort(classes)
    sizes = np.array([len(points[k]) // KIND.itemsize for k in order], "i8")
    rows = np.frombuffer(b"".join(points[k] for k in order), KIND)
    return rows, np.repeat(classes[order], sizes), np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _agreeing(a: np.ndarray, b: np.ndarray, pair: np.ndarray, i: np.ndarray, j: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """(pair, agreeing): the most descriptors that agree on one placement.

    ``a[k]`` and ``b[k]`` have met; ``i`` and ``j`` tell them apart within
    their images. The query is turned, scaled, then shifted.
    """
    turn = (b["turn"].astype("i8") - a["turn"]) % TURNS
    angle, sizes = turn * (2 * np.pi / TURNS), 1 / np.array(SCALES)
    ratio = sizes[b["level"]] / sizes[a["level"]]
    left = b["x"] - ratio * (np.cos(angle) * a["x"] - np.sin(angle) * a["y"])
    top = b["y"] - ratio * (np.sin(angle) * a["x"] + np.cos(angle) * a["y"])
    scale = np.rint(ratio * 1000).astype("i8")
    best_pair = np.unique(pair)
    best = np.zeros(len(best_pair), "i8")
    # Each vote counts in cells that overlap by half, for its own turn and the next one.
    for dx, dy, dt in itertools.product((0.0, 0.5), (0.0, 0.5), (0, 1)):
        spot = np.stack([pair, (turn + dt) % TURNS, scale, np.floor(left / cell + dx).astype("i8"), np.floor(top / cell + dy).astype("i8")], 1)
        spots, at = np.unique(spot, axis=0, return_inverse=True)
        at = at.ravel()
        n = [np.bincount(np.unique(np.stack([at, k], 1), axis=0)[:, 0], minlength=len(spots)) for k in (i, j)]
        np.maximum.at(best, np.searchsorted(best_pair, spots[:, 0]), np.minimum(*n))
    return best_pair, best


def _matched(queries: pa.Table, media: pa.Table, differing: int, cell: float, agreeing: int) -> Iterator[pa.RecordBatch]:
    """Links between the classes of two parts.

    Query classes are taken some at a time, so that no more than about
    ``MET`` descriptors that share a key are held at once, unless one class
    alone has more.
    """
    a, a_class, i_of = _read(queries)
    b, b_class, j_of = _read(media)
    words = [np.ascontiguousarray(x["bits"]).view("<u8") for x in (a, b)]
    keys = [np.ascontiguousarray(x["bits"]).view("<u4") for x in (a, b)]
    orders = [np.argsort(keys[1][:, t], kind="stable") for t in range(TABLES)]
    sorted_keys = [keys[1][o, t] for t, o in enumerate(orders)]
    low = np.stack([np.searchsorted(k, keys[0][:, t], "left") for t, k in enumerate(sorted_keys)])
    met = np.stack([np.searchsorted(k, keys[0][:, t], "right") for t, k in enumerate(sorted_keys)]) - low
    starts = np.flatnonzero(np.append(True, a_class[1:] != a_class[:-1])) if len(a) else np.zeros(0, "i8")
    ends, sums = np.append(starts[1:], len(a)), np.append(0, np.cumsum(met.sum(axis=0)))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(sums[ends], sums[starts[first]] + MET, "right")))
        lo, hi = int(starts[first]), int(ends[last - 1])
        first, found = last, [np.zeros(0, "i8")]
        for t in range(TABLES):
            n, upto = met[t, lo:hi], np.append(0, np.cumsum(met[t, lo:hi]))
            for at in range(0, int(upto[-1]), MET):
                nth = np.arange(at, min(at + MET, int(upto[-1])))
                row = np.searchsorted(upto, nth, "right") - 1
                i = row + lo
                j = orders[t][low[t, i] + nth - upto[row]]
                near = np.bitwise_count(words[0][i] ^ words[1][j]).sum(axis=1) <= differing
                found.append(np.unique(i[near] * len(b) + j[near]))
        i, j = np.divmod(np.unique(np.concatenate(found)), max(1, len(b)))
        # Images that share fewer descriptors on either side cannot agree on so many.
        pairs, pair = np.unique(np.stack([a_class[i], b_class[j]], 1), axis=0, return_inverse=True)
        pair = pair.ravel()
        enough = np.minimum(*[np.bincount(np.unique(np.stack([pair, k], 1), axis=0)[:, 0], minlength=len(pairs)) for k in (i, j)]) >= agreeing
        held = enough[pair]
        i, j, pair = i[held], j[held], pair[held]
        if not len(i):
            continue
        who, votes = _agreeing(a[i], b[j], pair, i_of[i], j_of[j], cell)
        who, votes = who[votes >= agreeing], votes[votes >= agreeing]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[who, 0]), pa.array(pairs[who, 1]), pa.array(votes)], ["id", "class_id", "agreeing"])


def find_copies(
    queries: DataFrame,
    media: DataFrame,
    *,
    id_col: str = "media_id",
    media_col: str = "media",
    differing: int = 32,
    cell: float = 12.0,
    agreeing: int = 4,
) -> DataFrame:
    """Members and links of image classes: kind, id, class_id, agreeing.

    A "query" or "media" row tells the class of one row: the least id of the
    rows on its side with the same bytes. A "link" row tells that the query
    class ``id`` shows (part of) the image of the media class ``class_id``,
    with the number of descriptors that agree on one placement. Every row of
    ``media`` is compared; there is no bound on the number of partners.

    Null media are one class, like any equal bytes. What cannot be decoded
    has a class but no links; so have images without corners. A class whose
    ids are all null has a null class_id and no links. Empty tables give no
    rows; other columns are ignored.
    """
    sides = {}
    for side, df in (("query", queries), ("media", media)):
        rows = stage(described(df, id_col, media_col), f"{side}-points")
        groups = rows.groupBy("digest").agg(F.min(F.struct("id", "points")).alias("first"), F.min("id").alias("class"))
        sides[side] = rows, stage(groups.select("digest", "class", "first.points"), f"{side}-classes")
    q, m = (sides[side][1].where("class IS NOT NULL AND length(points) > 0") for side in ("query", "media"))
    asked, held = _parts(q, 1), _parts(m, PARTS)
    q, m = _dealt(q, "q", asked, "m", held), _dealt(m, "m", held, "q", asked)

    def matched(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = pa.schema([("id", pa.int64()), ("class_id", pa.int64()), ("agreeing", pa.int64())])
        return pa.Table.from_batches(_matched(a, b, differing, cell, agreeing), kind) if len(a) and len(b) else kind.empty_table()

    links = q.groupBy("q", "m").cogroup(m.groupBy("q", "m")).applyInArrow(matched, "id long, class_id long, agreeing long")
    out = links.select(F.lit("link").alias("kind"), "id", "class_id", "agreeing")
    for side in ("query", "media"):
        rows, groups = sides[side]
        member = rows.select("id", "digest").join(groups.select("digest", "class"), "digest")
        out = out.unionByName(member.select(F.lit(side).alias("kind"), "id", F.col("class").alias("class_id"), F.lit(None).cast("long").alias("agreeing")))
    return out
