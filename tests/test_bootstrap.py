"""Bootstrap against replicates drawn one by one, over several blocks and ranges; ranking with all scores equal."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.operators import bootstrap, detection


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def slow_draws(ids, samples, seed, block):
    """Images of each replicate, with repeats."""
    order = sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    n = len(order)
    for rep in range(samples):
        seen, out = {}, []
        for j in range(n):
            b = draw(rep, j, seed) % n // block
            d = seen[b] = seen.get(b, -1) + 1
            out.append(order[b * block + draw(rep, b, d, seed) % min(block, n - b * block)])
        yield out


def slow_ap(rows, images, truths):
    """Images with repeats; each stands for its rows."""
    total = sum(truths.get(i, 0) for i in images)
    if not total:
        return math.nan
    times = {i: images.count(i) for i in set(images)}
    tp = seen = 0
    curve = []
    for _, i, _, hit in sorted((-s, i, p, h) for i, p, s, h in rows if i in times):
        tp, seen = tp + hit * times[i], seen + times[i]
        curve.append((tp / total, tp / seen))
    return sum(max((p for r, p in curve if r >= (1.0 if k == 100 else k * 0.01)), default=0) for k in range(101)) / 101


@pytest.mark.parametrize("block", [4096, 7])
def test_bootstrap_mean(spark, block):
    rng = np.random.default_rng(1)
    values = {i * 3: float(rng.normal()) for i in range(40)}
    df = spark.createDataFrame(list(values.items()), "image_id long, value double")
    got = {r.rep: r.value for r in bootstrap.bootstrap_mean(df, 30, 5, block).collect()}
    want = [np.mean([values[i] for i in images]) for images in slow_draws(values, 30, 5, block)]
    assert [got[k] for k in range(30)] == pytest.approx(want)
    assert bootstrap.bootstrap_mean(df.limit(0), 30, 5, block).count() == 0


@pytest.mark.parametrize(("block", "vector_rows"), [(4096, 2000), (7, 9)])
def test_bootstrap_ap(spark, block, vector_rows):
    rng = np.random.default_rng(2)
    rows, truths = [], {}
    for i in range(30):
        truths[i] = int(rng.integers(0, 4)) if i % 5 else 0
        hits = truths[i]
        for p in range(int(rng.integers(0, 6))):
            hit = int(hits > 0 and rng.random() < 0.6)
            hits -= hit
            rows.append((i, p, round(float(rng.random()), 1), hit))
    df = spark.createDataFrame(rows, "image_id long, pred_idx int, score double, hit int")
    units = spark.createDataFrame(list(truths.items()), "image_id long, truths int")
    got = {r.rep: r.ap for r in bootstrap.bootstrap_ap(df, units, 20, 3, block, vector_rows).collect()}
    want = {-1: slow_ap(rows, list(truths), truths)} | {k: slow_ap(rows, images, truths) for k, images in enumerate(slow_draws(truths, 20, 3, block))}
    assert got == pytest.approx(want, nan_ok=True)


def test_equal_scores_are_ranked_in_ranges(spark):
    rows = spark.range(20_000).select(F.lit(0.5).alias("threshold"), F.col("id").alias("image_id"), F.lit(0).alias("pred_idx"), F.lit(0.75).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("hit"))
    cut = detection.ranged(rows, ["threshold"], 1000)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000
    got = detection.ranked_sums(rows, ["threshold"], {"tp": F.col("hit"), "seen": F.lit(1)}, 1000).orderBy("image_id").select("seen", "tp").collect()
    assert [tuple(r) for r in got] == [(i + 1, i // 3 + 1) for i in range(20_000)]
