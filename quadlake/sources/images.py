"""Signatures of images: small grey thumbnails as unit vectors, for near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of blue, green and red in grey.
GREY = (0.114, 0.587, 0.299)


def thumbnail(pixels: np.ndarray, side: int) -> np.ndarray:
    """Means of `side` x `side` blocks of a grey image; blocks differ by a row or column where the size isn't a multiple, and images
    with fewer rows or columns repeat them."""
    for axis in (0, 1):
        n = pixels.shape[axis]
        cut = np.arange(side + 1) * n // side
        if n < side:
            pixels = pixels.take(cut[:-1], axis)
        else:
            pixels = np.add.reduceat(pixels, cut[:-1], axis) / np.diff(cut).reshape((-1, 1) if axis == 0 else (1, -1))
    return pixels


def signature(data: bytes, width: int, height: int, channels: int, side: int) -> np.ndarray:
    """An image's thumbnail less its mean, with norm 1; zeros for an image of one grey. data: rows of pixels of one channel, or of blue,
    green, red and perhaps an alpha channel, which has no say."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    grey = raw[:, :, 0] if channels == 1 else raw[:, :, :3] @ np.array(GREY)
    off = thumbnail(grey, side).ravel()
    off = off - off.mean()
    norm = np.linalg.norm(off)
    return off / norm if norm > 1e-9 else np.zeros_like(off)


def image_signatures(spark: SparkSession, root: str, side: int = 16) -> DataFrame:
    """path, sig (side * side numbers) of every image below root that the JVM can decode; others are left out. One map over the
    files: an image leaves its task as its signature only."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            sigs = [signature(data, w, h, n, side) for data, w, h, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.float64()))], names=["path", "sig"])

    columns = [F.col(f"image.{c}") for c in ("origin", "data", "width", "height", "nChannels")]
    return images.select(*columns).mapInArrow(sign, "path string, sig array<double>")
