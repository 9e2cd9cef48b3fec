"""Images for the media query, drawn from the vectors of ``embeddings``.

The tables hold no images, so each vector is drawn: a rough field with
rectangles of other shades, all following from the vector's bytes. Equal
vectors give equal images.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 96


def drawn(vector: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(vector.astype("<f4").tobytes()))
    coarse = rng.normal(0, 45, (SIDE // 3 + 2,) * 2).astype("f4")
    at = np.arange(SIDE) / 3
    low, part = at.astype(int), (at % 1).astype("f4")
    rows = coarse[low] * (1 - part)[:, None] + coarse[low + 1] * part[:, None]
    out = 128 + rows[:, low] * (1 - part) + rows[:, low + 1] * part
    for _ in range(10):
        a, b = rng.integers(0, SIDE - 8, 2)
        h, w = rng.integers(8, 34, 2)
        out[a : a + h, b : b + w] += rng.integers(-40, 40)
    return out.clip(0, 255)


def edited(image: np.ndarray, way: int, seed: int) -> np.ndarray:
    """Cropped; cropped and brightened; turned by 90 degrees; written over."""
    if way == 0:
        return image[14:, 10:]
    if way == 1:
        return (image[:-12, 8:-4] * 0.85 + 24).clip(0, 255)
    if way == 2:
        return np.rot90(image[4:, :-6])
    out = image.copy()
    out[30:42, 8:60] = 255
    return (out + np.random.default_rng(seed).normal(0, 1, out.shape)).clip(0, 255)


def resized(image: np.ndarray, factor: float) -> np.ndarray:
    """Larger or smaller by a factor, by bilinear weights."""
    return placed(image, tuple(int(n * factor) for n in image.shape), np.eye(2) / factor)


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre, with the edge repeated where it lacks pixels."""
    a = np.deg2rad(degrees)
    return placed(image, image.shape, np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]))


def placed(image: np.ndarray, shape: tuple[int, int], turn: np.ndarray) -> np.ndarray:
    """An image of a shape whose pixels come from where ``turn`` takes them,
    seen from the centres."""
    at = np.stack(np.mgrid[: shape[0], : shape[1]], -1) - (np.array(shape) - 1) / 2
    at = (at @ turn.T + (np.array(image.shape) - 1) / 2).clip(0, np.array(image.shape) - 1)
    low = np.minimum(at.astype(int), np.array(image.shape) - 2)
    (y, x), (fy, fx) = np.moveaxis(low, -1, 0), np.moveaxis(at - low, -1, 0)
    top = image[y, x] * (1 - fx) + image[y, x + 1] * fx
    return top * (1 - fy) + (image[y + 1, x] * (1 - fx) + image[y + 1, x + 1] * fx) * fy


def pgm(image: np.ndarray) -> bytes:
    whole = np.rint(image).astype("u1")
    return b"P5 %d %d 255\n" % whole.shape[::-1] + whole.tobytes()


def images(vectors: DataFrame, edit: bool = False) -> DataFrame:
    """(media_id, media): a PGM for each vector, edited if asked; null for a
    null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                media = []
                for key, v in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if v is None:
                        media.append(None)
                        continue
                    image = drawn(np.array(v, "f4"))
                    seed = zlib.crc32(image.tobytes())
                    media.append(pgm(edited(image, seed % 4, seed) if edit else image))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(media, pa.binary())], ["media_id", "media"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "media_id long, media binary")
