"""Exact percentiles against numpy, with ties, small windows, nulls and groups of different sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=5000), "b": np.round(rng.exponential(size=3000), 1), "c": np.full(400, 0.25), "d": np.array([7.0]), "e": np.array([1.0, 2.0])}
    data = [(k, float(v), float(v) if i % 3 else None) for k, vs in values.items() for i, v in enumerate(vs)] + [("f", None, None)]
    return spark.createDataFrame(data, "k string, v double, w double").repartition(8), values


TARGETS = {"v5": ("v", 0.05), "v50": ("v", 0.5), "w95": ("w", 0.95), "least": ("v", 0.0), "most": ("v", 1.0)}


@pytest.mark.parametrize("most", [100_000, 5])
def test_equals_numpy(rows, most):
    df, values = rows
    got = {r.k: r for r in exact_percentiles(df, ["k"], TARGETS, most=most).collect()}
    assert set(got) == {*values, "f"} and all(got["f"][n] is None for n in TARGETS)
    for k, v in values.items():
        w = np.array([x for i, x in enumerate(v) if i % 3])
        for name, (c, p) in TARGETS.items():
            own = v if c == "v" else w
            assert got[k][name] == (pytest.approx(np.percentile(own, 100 * p), abs=1e-12) if len(own) else None)


def test_without_keys_and_rows(rows):
    df, values = rows
    every = np.concatenate(list(values.values()))
    (r,) = exact_percentiles(df, [], {"m": ("v", 0.5)}).collect()
    assert r.asDict() == {"m": pytest.approx(np.median(every))}
    assert exact_percentiles(df.where("k = 'none'"), ["k"], TARGETS).count() == 0
    assert exact_percentiles(df.where(F.col("k") == "f"), ["k"], TARGETS).collect()[0]["v5"] is None
