"""Annotations of images: canonical quads, the relative-area filter, the border policy and the visibility audit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import PARAMS, Params
from .overlap import covered_by_others, intersections


def annotate(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Boxes in pixels -> quad_n on the grid, quad_px, and the image's size. Without `images` boxes have width and height."""
    b = boxes if images is None else boxes.join(images, "image_id")
    size = (F.col("width"), F.col("height"))
    corners = [g.xy(g.box_quad(*[F.col(c) for c in ("cx", "cy", "w", "h", "theta")]), i) for i in range(4)]
    on = b.withColumn("quad_n", g.quad([tuple(g.snap(v / n) for v, n in zip(p, size, strict=True)) for p in corners]))
    return on.withColumn("quad_px", g.quad([tuple(v * n for v, n in zip(g.xy(F.col("quad_n"), i), size, strict=True)) for i in range(4)]))


def validate(q: Column) -> tuple[Column, Column]:
    """(accepted, outside the frame): finite, within [-0.5, 1.5], four vertices, an area."""
    bad = F.exists(q, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | ~p["x"].between(-0.5, 1.5) | ~p["y"].between(-0.5, 1.5))
    ok = (F.size(q) == 4) & ~bad & (F.abs(g.signed_area(q)) >= 1e-12) & (F.size(F.array_distinct(q)) == 4)
    return ok, g.out_of_bounds(q)


def area_filter(annotations: DataFrame, least: float = PARAMS.min_relative_area) -> DataFrame:
    """Adds relative_area (to the largest of the image) and kept; indices stay as they were. The ratio needs no image size."""
    return kept_by_area(annotations.withColumn("area", F.abs(g.signed_area(F.col("quad_n")))), least)


def kept_by_area(annotations: DataFrame, least: float = PARAMS.min_relative_area) -> DataFrame:
    """area_filter where the column area is there already."""
    by = Window.partitionBy("image_id")
    return annotations.withColumn("relative_area", F.col("area") / F.max("area").over(by)).withColumn("kept", F.col("relative_area") >= least)


def counts(rows: DataFrame) -> DataFrame:
    """One row: the rows and their images. Images are counted one by one where rows are dealt by image, so no id is sent."""
    per = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("image_id").alias("images"))


def prepare(filtered: DataFrame, policy: str, fraction: float = PARAMS.pad_fraction) -> DataFrame:
    """Border policy keep, clip or pad for kept annotations: quad_out, adjusted, clipped_after_pad and the written size."""
    if policy not in ("keep", "clip", "pad"):
        raise ValueError(f"unknown policy {policy!r}")
    q = F.col("quad_n")
    out = filtered.where("kept").withColumn("adjusted", g.out_of_bounds(q))
    if policy == "keep":
        return out.withColumns({"quad_out": q, "clipped_after_pad": F.lit(False), "out_width": F.col("width"), "out_height": F.col("height")})
    if policy == "clip":
        clipped = F.when(F.col("adjusted"), g.clip(q)).otherwise(q)
        return out.withColumns({"quad_out": clipped, "clipped_after_pad": F.lit(False), "out_width": F.col("width"), "out_height": F.col("height")})
    out = out.withColumn("padded", g.pad(q, fraction)).withColumn("clipped_after_pad", g.out_of_bounds(F.col("padded")))
    size = lambda c: (F.col(c) + 2 * F.bround(F.col(c) * fraction)).cast("int")
    return out.withColumns({"quad_out": F.when(F.col("clipped_after_pad"), g.clip(F.col("padded"))).otherwise(F.col("padded")), "out_width": size("width"), "out_height": size("height")}).drop("padded")


def scenes(filtered: DataFrame) -> DataFrame:
    """image_id, n, scene: fan if the image has more than one annotation, dropped ones included."""
    return filtered.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).withColumn("scene", F.when(F.col("n") > 1, "fan").otherwise("single"))


def visibility(kept: DataFrame, threshold: float = PARAMS.visibility_threshold) -> DataFrame:
    """Findings: annotations of which the union of all others leaves less than threshold visible, with the dominant occluder."""
    polygons = kept.select("image_id", F.col("ann_idx").alias("idx"), F.col("quad_px").alias("q"))
    hidden = covered_by_others(polygons, ["image_id"]).withColumn("visible_fraction", F.greatest(F.lit(0.0), 1 - F.col("covered") / F.col("area")))
    flagged = hidden.where(F.round("visible_fraction", 9) < threshold)
    return flagged.join(dominant(polygons), ["image_id", "idx"], "left").select("image_id", F.col("idx").alias("ann_idx"), "visible_fraction", "dominant_idx", "dominant_fraction")


def dominant(polygons: DataFrame) -> DataFrame:
    """For each polygon the one that covers most of it; the first on ties."""
    pairs = intersections(polygons.withColumnRenamed("idx", "a_idx").withColumnRenamed("q", "qa"), polygons.withColumnRenamed("idx", "b_idx").withColumnRenamed("q", "qb"), ["image_id"], F.col("a_idx") != F.col("b_idx"))
    share = pairs.where("inter > 0").withColumn("fraction", F.col("inter") / F.col("area_a"))
    best = share.groupBy("image_id", F.col("a_idx").alias("idx")).agg(F.max(F.struct(F.round("fraction", 9), -F.col("b_idx"), "b_idx", "fraction")).alias("m"))
    return best.select("image_id", "idx", F.col("m.b_idx").alias("dominant_idx"), F.col("m.fraction").alias("dominant_fraction"))


def overlap_components(polygons: DataFrame) -> DataFrame:
    """image_id, idx, component: connected components of positive overlap within an image, named by their least index.

    An image has few boxes, so its edges are folded in one pass: each edge joins the two labels that it touches.
    """
    pairs = intersections(polygons.withColumnRenamed("idx", "a_idx").withColumnRenamed("q", "qa"), polygons.withColumnRenamed("idx", "b_idx").withColumnRenamed("q", "qb"), ["image_id"], F.col("a_idx") < F.col("b_idx")).where(F.col("inter") > 1e-6)
    edges = pairs.groupBy("image_id").agg(F.collect_list(F.struct("a_idx", "b_idx")).alias("edges"))
    nodes = polygons.groupBy("image_id").agg(F.array_sort(F.collect_list("idx")).alias("nodes"))
    start = F.transform("nodes", lambda n: F.struct(n.alias("idx"), n.alias("label")))

    def join(acc: Column, e: Column) -> Column:
        label = lambda i: F.get(F.filter(acc, lambda x: x["idx"] == i), F.lit(0))["label"]
        low, high = F.least(label(e["a_idx"]), label(e["b_idx"])), F.greatest(label(e["a_idx"]), label(e["b_idx"]))
        return F.transform(acc, lambda x: F.struct(x["idx"].alias("idx"), F.when(x["label"] == high, low).otherwise(x["label"]).alias("label")))

    empty = F.array().cast("array<struct<a_idx:int,b_idx:int>>")
    folded = nodes.join(edges, "image_id", "left").withColumn("out", F.aggregate(F.coalesce("edges", empty), start, join))
    return folded.select("image_id", F.explode("out").alias("o")).select("image_id", F.col("o.idx").alias("idx"), F.col("o.label").alias("component"))


_EXACT = 9


def violation_bound(polygons: DataFrame, findings: DataFrame, params: Params = PARAMS) -> DataFrame:
    """image_id, flagged, bound: how many of an image's findings can be real at once under some order of depth.

    Summed over all overlap components of images with findings; exact up to nine members, else the size less one.
    """
    flagged = findings.groupBy("image_id").agg(F.count(F.lit(1)).alias("flagged"))
    own = overlap_components(polygons).join(polygons, ["image_id", "idx"]).join(flagged.select("image_id"), "image_id", "left_semi")
    sized = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("image_id", "component")))
    large = sized.where(F.col("n") > _EXACT).groupBy("image_id", "component").agg((F.max("n") - 1).cast("int").alias("bound"))
    threshold = params.visibility_threshold

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        from .depth import most_hidden

        quads = [[(p["x"], p["y"]) for p in q] for q in pdf.sort_values("idx")["q"]]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "component": [pdf["component"].iloc[0]], "bound": [most_hidden(quads, threshold)]})

    small = sized.where(F.col("n").between(2, _EXACT)).select("image_id", "component", "idx", "q").groupBy("image_id", "component").applyInPandas(exact, "image_id long, component int, bound int")
    total = small.unionByName(large).groupBy("image_id").agg(F.sum("bound").alias("bound"))
    return flagged.join(total, "image_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
