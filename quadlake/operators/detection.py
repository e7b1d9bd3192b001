"""Average precision from ranked outcomes, and intervals over replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of a range of the ranking.
RANGE_ROWS = 200_000


def ranged(rows: DataFrame, keys: list[str], range_rows: int) -> DataFrame:
    """Adds _range: rows in the order of keys, descending score, image_id, pred_idx are cut into ranges of about `range_rows`. The
    cuts are whole sort keys, so rows of one score are parted like others. Written: a range's number must not change."""
    n = max(1, -(-rows.count() // range_rows))
    return written(rows.repartitionByRange(n, *keys, F.desc("score"), "image_id", "pred_idx").withColumn("_range", F.spark_partition_id()))


def ranked_sums(rows: DataFrame, keys: list[str], sums: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds running sums in the order of descending score, image_id, pred_idx within keys.

    No task sees a whole key: a prefix sum over the totals of ranges of equal depth (see ranged) gives where each starts, and a
    window runs inside a range only.
    """
    cut = ranged(rows, keys, range_rows).withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    order = Window.partitionBy(*keys, "_range").orderBy(F.desc("score"), "image_id", "pred_idx").rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumns({n: F.sum(f"_v_{n}").over(order) for n in sums})
    out = inner.join(starts, [*keys, "_range"]).withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in sums})
    return out.drop("_range", *[f"_{k}_{n}" for k in "vts" for n in sums])


def pr_curve(found: DataFrame, n_truths: DataFrame, keys: list[str]) -> DataFrame:
    """Adds precision and recall to scored outcomes. found: keys, image_id, pred_idx, score, hit; n_truths: keys, n_truths."""
    sums = ranked_sums(found, keys, {"tp": F.col("hit"), "seen": F.lit(1)})
    sums = sums.join(n_truths, keys) if keys else sums.crossJoin(F.broadcast(n_truths))
    return sums.withColumns({"precision": F.col("tp") / F.col("seen"), "recall": F.when(F.col("n_truths") > 0, F.col("tp") / F.col("n_truths"))})


def mean_of_envelope(best: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap from the best precision of each last recall point: a point has the best of those that reach it."""
    points = best.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).groupBy(*keys, "i").agg(F.max("precision").alias("p"))
    return points.groupBy(*keys).agg((F.sum("p") / 101).alias("ap"))


def average_precision(found: DataFrame, n_truths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap: the mean over 101 recall points i * 0.01 of the best precision at that recall or beyond; NaN without truths, 0
    without detections. A row counts for the points up to its recall, so only the best precision for each last point is kept
    (101 rows for a key) and the envelope is a maximum over those."""
    curve = pr_curve(found, n_truths, keys).where("n_truths > 0")
    return _ap_or_nan(n_truths, mean_of_envelope(_best_of_points(curve, keys), keys), keys)


def _best_of_points(curve: DataFrame, keys: list[str]) -> DataFrame:
    j = F.floor(F.col("recall") * 100)
    last = F.when((j + 1) * 0.01 <= F.col("recall"), j + 1).when(j * 0.01 <= F.col("recall"), j).otherwise(j - 1)
    return curve.withColumn("last", F.least(last, F.lit(100))).groupBy(*keys, "last").agg(F.max("precision").alias("precision"))


def _ap_or_nan(n_truths: DataFrame, ap: DataFrame, keys: list[str]) -> DataFrame:
    out = n_truths.join(ap, keys, "left")
    return out.select(*keys, F.when(F.col("n_truths") > 0, F.coalesce("ap", F.lit(0.0))).otherwise(F.lit(float("nan"))).alias("ap"))


def average_precisions(found: DataFrame, n_truths: DataFrame, at) -> DataFrame:
    """threshold, ap of several thresholds at once, as average_precision. found: a row a prediction with image_id, pred_idx, score and
    bits hits and excused, bit k for the k-th threshold; n_truths: one row. The order is the same at all thresholds, so a row
    travels once and not once for each."""
    bit = lambda c, k: F.getbit(c, F.lit(k)).cast("int")
    sums = {}
    for k in range(len(at)):
        sums |= {f"tp{k}": bit("hits", k), f"seen{k}": 1 - bit("excused", k)}
    hit = F.col("hits") != 0  # elsewhere no precision is better than at the row before
    curve = ranked_sums(found.select("image_id", "pred_idx", "score", "hits", "excused"), [], sums).where(hit).crossJoin(F.broadcast(n_truths))
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), bit("hits", k).alias("hit"), F.col(f"tp{k}").alias("tp"), F.col(f"seen{k}").alias("seen")) for k, t in enumerate(at)])).alias("e")
    long = curve.select("n_truths", each).where("e.hit = 1").select("e.threshold", (F.col("e.tp") / F.col("e.seen")).alias("precision"), (F.col("e.tp") / F.col("n_truths")).alias("recall"))
    ap = mean_of_envelope(_best_of_points(long, ["threshold"]), ["threshold"])
    every = n_truths.select(F.explode(F.array(*[F.lit(float(t)) for t in at])).alias("threshold"), "n_truths")
    return _ap_or_nan(every, ap, ["threshold"])


def interval(values: DataFrame, value: str, point: DataFrame, n: int, samples: int) -> DataFrame:
    """One row: the point, the 2.5th and 97.5th percentiles over replicates that aren't NaN, n and samples. With fewer than two
    units the bounds are NaN and samples is 0."""
    nan = F.lit(float("nan"))
    ends = values.where(~F.isnan(value)).agg(F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"))
    few = n < 2
    return point.crossJoin(ends).select("value", (nan if few else F.coalesce("lo", nan)).alias("ci_low"), (nan if few else F.coalesce("hi", nan)).alias("ci_high"), F.lit(n).cast("long").alias("n"), F.lit(0 if few else samples).cast("long").alias("samples"))
