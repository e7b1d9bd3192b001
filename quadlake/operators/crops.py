"""What a crop around a matched prediction holds: coverage of its truth and contamination by other annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import PARAMS, Params
from ..scratch import written
from .overlap import covered_by
from .quantiles import exact_percentiles


def crop_samples(matches: DataFrame, predictions: DataFrame, truths: DataFrame, ignored: DataFrame, scenes: DataFrame, margins=(PARAMS.margin,)) -> DataFrame:
    """margin, image_id, truth_idx, detected, coverage, contamination, scene for every truth and margin.

    Coverage is the share of the truth inside the expanded prediction, 0 if missed. Contamination is the share of the crop
    under the union of all other truths and ignored quads; null if missed.
    """
    crops = matches.select("image_id", "pred_idx", "truth_idx").join(predictions.select("image_id", "pred_idx", "q"), ["image_id", "pred_idx"])
    crops = crops.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins]))).withColumn("q", g.expand(F.col("q"), F.col("margin")))
    crops = written(crops)
    keys = ["margin", "image_id", "truth_idx"]
    targets = truths.join(crops.select(*keys), ["image_id", "truth_idx"]).select(*keys, F.lit(0).alias("idx"), "q")
    coverage = covered_by(targets, crops.select(*keys, F.lit(0).alias("c_idx"), "q"), keys).select(*keys, (F.col("covered") / F.col("area")).alias("coverage"))
    rest = truths.select("image_id", F.col("truth_idx").alias("c_idx"), "q").unionByName(ignored.select("image_id", F.col("truth_idx").alias("c_idx"), "q"))
    others = crops.select(*keys).join(rest, "image_id").where("c_idx <> truth_idx")
    spoiled = covered_by(crops.select(*keys, F.lit(0).alias("idx"), "q"), others, keys).select(*keys, (F.col("covered") / F.col("area")).alias("contamination"))
    every = truths.select("image_id", "truth_idx").withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    out = every.join(coverage, keys, "left").join(spoiled, keys, "left").join(scenes.select("image_id", "scene"), "image_id")
    seen = F.col("coverage").isNotNull()
    one = F.lit(1.0)
    return out.select(*keys, seen.alias("detected"), F.when(seen, F.least(one, "coverage")).otherwise(0.0).alias("coverage"), F.when(seen, F.least(one, "contamination")).alias("contamination"), "scene")


def summary(samples: DataFrame, params: Params = PARAMS) -> DataFrame:
    """One row for each margin."""
    hit = F.when(F.col("detected"), F.col("coverage"))
    s = written(samples.select("margin", "detected", "coverage", "contamination", hit.alias("hit")))
    low, high = params.coverage_percentile / 100, params.contamination_percentile / 100
    targets = {"coverage_p5_all": ("coverage", low), "coverage_p5_detected": ("hit", low), "coverage_median": ("coverage", 0.5), "contamination_p95": ("contamination", high), "contamination_median": ("contamination", 0.5)}
    counts = s.groupBy("margin").agg(F.count(F.lit(1)).alias("n_truths"), F.sum(F.col("detected").cast("long")).alias("detected"))
    out = counts.join(exact_percentiles(s, ["margin"], targets), "margin").na.fill(0.0, list(targets))
    return out.withColumn("meets_target", F.col("coverage_p5_all") >= params.coverage_target)


def by_scene(samples: DataFrame, params: Params = PARAMS) -> DataFrame:
    """margin, scene, n, median, p95, threshold, passes; both scenes for each margin. Without samples a scene passes."""
    limits = F.explode(F.create_map(F.lit("single"), F.lit(params.single_max), F.lit("fan"), F.lit(params.fan_max))).alias("scene", "threshold")
    every = samples.select("margin").distinct().select("margin", limits)
    seen = written(samples.where("detected and contamination is not null").select("margin", "scene", "contamination"))
    ends = exact_percentiles(seen, ["margin", "scene"], {"median": ("contamination", 0.5), "p95": ("contamination", params.contamination_percentile / 100)})
    got = seen.groupBy("margin", "scene").agg(F.count(F.lit(1)).alias("n")).join(ends, ["margin", "scene"])
    out = every.join(got, ["margin", "scene"], "left").na.fill({"n": 0, "median": 0.0, "p95": 0.0})
    return out.withColumn("passes", (F.col("n") == 0) | (F.col("p95") <= F.col("threshold")))


def geometry_diagnostics(matches: DataFrame, predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """One row: median and 95th percentile of angle error (degrees, pixel aspect), vertex distance (px) and its share of the
    truth's longest side, over matched pairs in canonical order."""
    one = F.lit(1.0)
    p = predictions.select("image_id", "pred_idx", g.canonical(F.col("q"), one).alias("cp"))
    t = truths.select("image_id", "truth_idx", g.canonical(F.col("q"), one).alias("ct"))
    pairs = matches.join(p, ["image_id", "pred_idx"]).join(t, ["image_id", "truth_idx"])
    angle = pairs.select(g.angle_error(g.angle_deg(F.col("cp"), one), g.angle_deg(F.col("ct"), one)).alias("angle"))
    longest = F.array_max(g.edge_lengths(F.col("ct"), one)).alias("longest")
    distance = pairs.select(longest, F.explode(F.zip_with("cp", "ct", lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))).alias("distance"))
    return geometry_summary(angle, distance.withColumn("share", F.col("distance") / F.col("longest")))


def geometry_summary(angle: DataFrame, distance: DataFrame) -> DataFrame:
    """One row: the number of angles, and median and 95th percentile of angle, distance and share."""
    angle, distance = written(angle.select("angle")), written(distance.select("distance", "share"))
    ends = lambda *cs: {f"{c}_{n}": (c, p) for c in cs for n, p in (("median", 0.5), ("p95", 0.95))}
    one_row = [angle.agg(F.count(F.lit(1)).alias("n_pairs")), exact_percentiles(angle, [], ends("angle")), exact_percentiles(distance, [], ends("distance", "share"))]
    return one_row[0].crossJoin(one_row[1]).crossJoin(one_row[2])
