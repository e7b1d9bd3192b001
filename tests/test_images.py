"""Thumbnails against plain loops, and signatures of written images."""

import numpy as np
import pytest

from quadlake.operators import duplicates
from quadlake.plans import trees
from quadlake.sources import images


@pytest.mark.parametrize("shape", [(16, 16), (33, 50), (5, 40), (1, 1), (160, 17)])
def test_thumbnails(shape):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, shape).astype(float)
    got = images.thumbnail(p, 16)
    for i in range(16):
        for j in range(16):
            r, c = ([k * n // 16 for k in (a, a + 1)] for a, n in ((i, shape[0]), (j, shape[1])))
            want = p[r[0] : max(r[1], r[0] + 1), c[0] : max(c[1], c[0] + 1)].mean()
            assert got[i, j] == pytest.approx(want)


def test_signatures():
    rng = np.random.default_rng(2)
    bgr = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    sig = images.signature(bgr.tobytes(), 30, 20, 3, 16)
    assert sig.mean() == pytest.approx(0, abs=1e-12) and np.linalg.norm(sig) == pytest.approx(1)
    alpha = np.concatenate([bgr, rng.integers(0, 256, (20, 30, 1)).astype(np.uint8)], axis=2)
    assert np.allclose(images.signature(alpha.tobytes(), 30, 20, 4, 16), sig)
    assert not images.signature(bytes([7]) * 100, 10, 10, 1, 16).any()


def test_written_images_and_their_copies(spark, tmp_path):
    from pyspark.sql import functions as F

    from quadlake.operators import exports

    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, 64))
    near = np.clip(base + rng.integers(-6, 7, base.shape), 0, 255)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([*base, *near])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    exports.write_tree(df.select(F.concat("id", F.lit(".png")).alias("relative_path"), trees.grey_png("v").alias("content")), f"file://{tmp_path}/x")
    (tmp_path / "x" / "broken.png").write_bytes(b"no image")
    sigs = images.image_signatures(spark, f"{tmp_path}/x").select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("id"), "sig")
    assert sigs.count() == 12
    assert {(r.a, r.b) for r in duplicates.near_pairs(sigs, 0.92).collect()} == {(k, k + 6) for k in range(6)}
