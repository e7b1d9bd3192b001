"""Greedy matching of predictions to truths, and rotated non-maximum suppression: ordered folds over an image's few boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import COCO_THRESHOLDS, PARAMS
from ..scratch import written
from .overlap import covered_by, rotated_iou


def thresholds(values) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("threshold")


def pair_ious(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """image_id, pred_idx, truth_idx, iou, level of overlapping pairs; level is the IoU to 9 digits, for comparisons only.
    predictions: pred_idx, q; truths: truth_idx, q."""
    a = predictions.select("image_id", F.col("pred_idx").alias("a_idx"), F.col("q").alias("qa"))
    b = truths.select("image_id", F.col("truth_idx").alias("b_idx"), F.col("q").alias("qb"))
    out = rotated_iou(a, b, ["image_id"]).where("inter > 0")
    return written(out.select("image_id", F.col("a_idx").alias("pred_idx"), F.col("b_idx").alias("truth_idx"), "iou", F.round("iou", 9).alias("level")))


def greedy_match(predictions: DataFrame, truths: DataFrame, at=(PARAMS.match_iou,)) -> DataFrame:
    """threshold, image_id, pred_idx, truth_idx, iou, score of matches.

    By descending score, then pred_idx, each prediction takes the free truth with the highest IoU (the first on ties) if it
    reaches the threshold; the class plays no part. Pairs below all thresholds never meet the fold: sorted by score and IoU,
    a pair matches if both of its ends are free.
    """
    low = min(at)
    pairs = pair_ious(predictions, truths).where(F.col("level") >= low).join(predictions.select("image_id", "pred_idx", "score"), ["image_id", "pred_idx"])
    per = pairs.select(thresholds(at), "*").where("level >= threshold")
    item = F.struct((-F.col("score")).alias("s"), F.col("pred_idx").alias("p"), (-F.col("level")).alias("v"), F.col("truth_idx").alias("t"), "iou")
    groups = per.groupBy("threshold", "image_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    add = lambda acc, x: F.when(F.exists(acc, lambda y: (y["p"] == x["p"]) | (y["t"] == x["t"])), acc).otherwise(F.array_append(acc, x))
    taken = groups.select("threshold", "image_id", F.explode(F.aggregate("items", none, add)).alias("m"))
    out = taken.select("threshold", "image_id", F.col("m.p").alias("pred_idx"), F.col("m.t").alias("truth_idx"), "m.iou", (-F.col("m.s")).alias("score"))
    return written(out)  # every metric starts from it


def ioa_ignored(predictions: DataFrame, ignored: DataFrame) -> DataFrame:
    """image_id, pred_idx, ioa: the share of each prediction under the union of the image's ignored quads."""
    out = covered_by(predictions.select("image_id", F.col("pred_idx").alias("idx"), "q"), ignored.select("image_id", F.col("truth_idx").alias("c_idx"), "q"), ["image_id"])
    return out.select("image_id", F.col("idx").alias("pred_idx"), F.round(F.col("covered") / F.col("area"), 9).alias("ioa"))


def outcomes(predictions: DataFrame, truths: DataFrame, ignored: DataFrame, at=(PARAMS.match_iou,), use_ignored: bool = True) -> DataFrame:
    """threshold, image_id, pred_idx, score, outcome (tp, ignored, fp), truth_idx, iou. An unmatched prediction is ignored if its
    share on ignored quads reaches the same threshold."""
    matched = greedy_match(predictions, truths, at).select("threshold", "image_id", "pred_idx", "truth_idx", "iou")
    every = predictions.select(thresholds(at), "image_id", "pred_idx", "score")
    out = every.join(matched, ["threshold", "image_id", "pred_idx"], "left").join(ioa_ignored(predictions, ignored), ["image_id", "pred_idx"])
    excused = (F.col("ioa") >= F.col("threshold")) & (F.col("ioa") > 0) if use_ignored else F.lit(False)
    kind = F.when(F.col("truth_idx").isNotNull(), "tp").when(excused, "ignored").otherwise("fp")
    return written(out.select("threshold", "image_id", "pred_idx", "score", kind.alias("outcome"), "truth_idx", "iou"))


def image_stats(found: DataFrame, images: DataFrame, truths: DataFrame, at=COCO_THRESHOLDS) -> DataFrame:
    """threshold, image_id, tp, fp, ignored, n_truths for every image of `images`."""
    n = truths.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_truths"))
    kinds = [F.sum((F.col("outcome") == k).cast("int")).cast("long").alias(k) for k in ("tp", "fp", "ignored")]
    counts = found.groupBy("threshold", "image_id").agg(*kinds)
    every = images.select("image_id").join(n, "image_id", "left").select(thresholds(at), "image_id", "n_truths")
    out = every.join(counts, ["threshold", "image_id"], "left")
    return out.select("threshold", "image_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("tp", "fp", "ignored", "n_truths")])


def rotated_nms(boxes: DataFrame, iou: float = PARAMS.nms_iou, most: int = PARAMS.max_detections) -> DataFrame:
    """image_id, box_idx of kept boxes. boxes: image_id, box_idx, q, score, area.

    By descending score, a box goes if its IoU with a kept box is over the limit; boxes without area are skipped and an image
    keeps `most` at most (a limit of the method). Only pairs over the limit reach the fold, as each box's list of rivals.
    """
    some = boxes.where("area > 0")
    side = lambda i, q: some.select("image_id", F.col("box_idx").alias(i), F.col("q").alias(q))
    close = rotated_iou(side("a_idx", "qa"), side("b_idx", "qb"), ["image_id"], F.col("a_idx") != F.col("b_idx")).where(F.round("iou", 9) > iou)
    rivals = close.groupBy("image_id", F.col("a_idx").alias("box_idx")).agg(F.collect_set("b_idx").alias("rivals"))
    joined = some.join(rivals, ["image_id", "box_idx"], "left")
    item = F.struct((-F.col("score")).alias("s"), F.col("box_idx").alias("b"), F.coalesce("rivals", F.array().cast("array<int>")).alias("r"))
    groups = joined.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    add = lambda acc, x: F.when((F.size(acc) >= most) | F.arrays_overlap(acc, x["r"]), acc).otherwise(F.array_append(acc, x["b"]))
    return groups.select("image_id", F.explode(F.aggregate("items", F.array().cast("array<int>"), add)).alias("box_idx"))
