"""Overlap of quads of any shape, against areas counted on a grid and against hand values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.functions import geometry as g
from quadlake.functions import kernels
from quadlake.operators.overlap import covered_by, intersections, union_area

QUAD = "array<struct<x:double,y:double>>"


def shape(rng, kind):
    """A box, a dart, or a box that crosses itself, either way round."""
    c, s = np.cos(t := rng.uniform(0, 6)), np.sin(t)
    p = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * rng.uniform(4, 12, 2)
    if kind == 1:
        p[int(rng.integers(4))] *= -rng.uniform(0.1, 0.5)
    if kind == 2:
        p = p[[0, 2, 1, 3]] * [[1], [1], [0.9], [0.4]]
    p = p @ np.array([[c, s], [-s, c]]) + rng.uniform(15, 25, 2)
    return p if rng.random() < 0.5 else p[::-1]


def inside(p, x, y):
    """Whether grid points are in a polygon's larger lobe or the polygon itself, by winding of each part."""
    wind = np.zeros(x.shape, int)
    for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, 0), strict=True):
        left = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        wind += ((y0 <= y) & (y1 > y) & (left > 0)).astype(int) - ((y0 > y) & (y1 <= y) & (left < 0)).astype(int)
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, np.roll(p, -1, 0), strict=True))
    return wind == (1 if area > 0 else -1)


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(4)
    step = 0.05
    x, y = np.meshgrid(np.arange(0, 40, step) + step / 2, np.arange(0, 40, step) + step / 2)
    rows, masks = [], {}
    for image in range(12):
        for idx in range(5):
            p = shape(rng, int(rng.integers(3)))
            rows.append((image, idx, [tuple(map(float, v)) for v in p]))
            masks[image, idx] = inside(p, x, y)
    return rows, masks, step * step


def test_intersections_and_unions_of_any_quads(spark, scene):
    rows, masks, cell = scene
    q = spark.createDataFrame(rows, f"image_id long, idx int, q {QUAD}")
    got = intersections(q.toDF("image_id", "a_idx", "qa"), q.toDF("image_id", "b_idx", "qb"), ["image_id"], F.col("a_idx") < F.col("b_idx")).collect()
    seen = {(r.image_id, r.a_idx, r.b_idx): r for r in got}
    for i in range(12):
        for a in range(5):
            for b in range(a + 1, 5):
                want = (masks[i, a] & masks[i, b]).sum() * cell
                r = seen.get((i, a, b))
                assert abs((r.inter if r else 0) - want) < 1.5
                if r:
                    assert abs(r.area_a - masks[i, a].sum() * cell) < 1.5
    for r in union_area(q, ["image_id"]).collect():
        want = np.logical_or.reduce([masks[r.image_id, k] for k in range(5)]).sum() * cell
        assert abs(r.union_area - want) < 2
    hidden = covered_by(q.where("idx = 0"), q.where("idx > 0").withColumnRenamed("idx", "c_idx"), ["image_id"]).collect()
    for r in hidden:
        others = np.logical_or.reduce([masks[r.image_id, k] for k in range(1, 5)])
        assert abs(r.covered - (masks[r.image_id, 0] & others).sum() * cell) < 2


def test_a_dart_in_its_box():
    box = np.array([[0, 4, 4, 0], [0, 0, 4, 4]], float)[:, :, None]
    dart = np.array([[0, 4, 1, 0], [0, 0, 1, 4]], float)[:, :, None]
    assert kernels.overlap(*dart, *box)[0] == pytest.approx(4) == kernels.overlap(*box, *dart)[0]
    assert kernels.overlap(*dart, *dart)[0] == pytest.approx(4)
    corner = np.array([[2, 4, 4, 2], [2, 2, 4, 4]], float)[:, :, None]
    assert kernels.overlap(*dart, *corner)[0] == pytest.approx(0)


def test_convexity(spark):
    square, dart, cross = ([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (0.0, 4.0), (1.0, 1.0), (4.0, 0.0)], [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 2.0)])
    q = g.polygon(F.col("q"))
    got = spark.createDataFrame([(0, square), (1, square[::-1]), (2, dart), (3, cross)], f"i int, q {QUAD}").select("i", g.signed_area(q).alias("area"), F.size(g.convex_parts(q)).alias("parts")).orderBy("i").collect()
    assert [(r.parts, round(r.area, 6)) for r in got] == [(1, 16.0), (1, 16.0), (2, 4.0), (1, round(16 / 3, 6))]
