"""The exact pair join against brute force, and how few rows travel when the data have structure."""

import numpy as np
import pytest

from quadlake.operators import duplicates

SIG = "id long, sig array<double>"


def unit(v):
    return v / np.linalg.norm(v, axis=1)[:, None]


def brute(v, threshold):
    return {(i, j) for j in range(len(v)) for i in range(j) if v[i] @ v[j] > threshold}


@pytest.fixture(scope="module")
def groups_of_copies():
    rng = np.random.default_rng(7)
    centres = unit(rng.normal(size=(60, 24)))
    near = np.repeat(centres, 20, axis=0)
    return unit(near + rng.normal(size=near.shape) * rng.choice([0.01, 0.06], size=(len(near), 1)))


@pytest.mark.parametrize(("threshold", "block_rows"), [(0.92, 40), (0.92, 5000), (0.35, 200), (-0.2, 400)])
def test_equals_brute_force(spark, groups_of_copies, threshold, block_rows):
    v = np.concatenate([groups_of_copies[:400], np.zeros((2, 24))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SIG).repartition(4)
    got = duplicates.near_pairs(df, threshold, block_rows).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == brute(v, threshold)
    assert all(abs(r.correlation - v[r.a] @ v[r.b]) < 1e-12 for r in got)


def test_rows_meet_few_blocks_in_structured_data(spark, groups_of_copies):
    """1,200 rows in 60 groups: all pairs of 60 blocks would copy each row 60 times."""
    v = groups_of_copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SIG).repartition(4)
    sent = duplicates.dealt(df, 0.92, 20)
    blocks = sent.select("block").distinct().count()
    assert blocks >= 50 and sent.count() < 0.25 * blocks * len(v)
    assert {(r.a, r.b) for r in duplicates.near_pairs(df, 0.92, 20).collect()} == brute(v, 0.92)


def test_a_crowded_cell_and_no_rows(spark):
    """All rows alike: one cell, cut into blocks of bounded size."""
    v = np.tile(unit(np.ones((1, 8))), (90, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SIG).repartition(4)
    sizes = [r["count"] for r in duplicates.dealt(df, 0.92, 10).where("block = lo and block = hi").groupBy("block").count().collect()]
    assert sum(sizes) == 90 and max(sizes) < 30
    assert duplicates.near_pairs(df, 0.92, 10).count() == 90 * 89 // 2
    assert duplicates.near_pairs(df.limit(0), 0.92).count() == 0
