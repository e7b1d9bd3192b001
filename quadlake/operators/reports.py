"""Reports and manifests as JSON documents of any size, the training view's data.yaml and the lists of a split's images."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from .annotations import counts


def document(items: DataFrame, order: list[Column], opening: Column | str, closing: str, head: DataFrame | None = None) -> DataFrame:
    """The lines of one JSON document, in order: an opening, the items (column `item`) and a closing.

    All items but the least begin with a comma, so no task holds the document: the parts that write.text makes, one after the
    other, are the document. `order` must tell items apart. `head` is the one row that `opening` refers to.
    """
    spark = items.sparkSession
    rows = items.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("at"), "item")
    least = rows.agg(F.min("at").alias("least"))
    lines = rows.crossJoin(F.broadcast(least)).select(F.lit(1).alias("section"), "at", F.when(F.col("at") == F.col("least"), F.col("item")).otherwise(F.concat(F.lit(","), "item")).alias("line"))
    no = F.lit(None).cast(rows.schema["at"].dataType)
    first = (head if head is not None else spark.range(1)).select(F.lit(0).alias("section"), no.alias("at"), (F.lit(opening) if isinstance(opening, str) else opening).alias("line"))
    last = spark.range(1).select(F.lit(2).alias("section"), no.alias("at"), F.lit(closing).alias("line"))
    return lines.unionByName(first).unionByName(last).orderBy("section", "at").select("line")


def number(c: Column) -> Column:
    """A number with six decimals, as JSON text."""
    return fixed(c, 6)


def text(c: Column) -> Column:
    """A string as JSON text, quoted and escaped; null is null."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1))


def member(**values: Column) -> Column:
    """A JSON object of values that are JSON text already."""
    parts: list[Column] = []
    for i, (k, v) in enumerate(values.items()):
        parts += [F.lit(f"{', ' if i else '{'}{json.dumps(k)}: "), v.cast("string")]
    return F.concat(*parts, F.lit("}"))


def group_manifest(groups: DataFrame) -> DataFrame:
    """The lines of {id: group} by ascending id. groups: id (unique), grp."""
    item = F.concat(text(F.col("id").cast("string")), F.lit(": "), text(F.col("grp").cast("string")))
    return document(groups.select("id", item.alias("item")).withColumn("key", F.col("id").cast("string")), [F.col("key")], "{", "}")


def filter_report(filtered: DataFrame, least: float) -> DataFrame:
    """The area filter's report: counts, and each annotation that it drops by image and index."""
    gone = ~F.col("kept")
    n = filtered.agg(F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("n"), F.count(F.when(gone, 1)).alias("dropped"), F.count_distinct(F.when(gone, F.col("image_id"))).alias("hit"))
    opening = F.concat(F.lit(f'{{"min_relative_area": {least}, "images_loaded": '), F.col("images").cast("string"), F.lit(', "annotations_read": '), F.col("n").cast("string"), F.lit(', "annotations_kept": '), (F.col("n") - F.col("dropped")).cast("string"), F.lit(', "annotations_dropped": '), F.col("dropped").cast("string"), F.lit(', "images_affected": '), F.col("hit").cast("string"), F.lit(', "dropped": ['))
    item = member(sample_id=F.col("image_id"), index=F.col("ann_idx"), relative_area=number(F.col("relative_area")))
    return document(filtered.where(gone).select("image_id", "ann_idx", item.alias("item")), [F.col("image_id"), F.col("ann_idx")], opening, "]}", n)


def visibility_report(kept: DataFrame, findings: DataFrame, threshold: float) -> DataFrame:
    """The visibility audit's report: what was checked, and each finding by image and index."""
    n = counts(kept)
    opening = F.concat(F.lit(f'{{"visibility_threshold": {threshold}, "images_checked": '), F.col("images").cast("string"), F.lit(', "annotations_checked": '), F.col("n").cast("string"), F.lit(', "findings": ['))
    item = member(sample_id=F.col("image_id"), annotation_index=F.col("ann_idx"), visible_fraction=number(F.col("visible_fraction")))
    return document(findings.select("image_id", "ann_idx", item.alias("item")), [F.col("image_id"), F.col("ann_idx")], opening, "]}", n)


def leakage_report(pairs: DataFrame, crossing: DataFrame, threshold: float) -> DataFrame:
    """The duplicate report: numbers of pairs, then the pairs across splits, the most alike first."""
    n = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    affected = crossing.select("a", "b", F.explode(F.array("a", "b")).alias("id")).agg(F.count_distinct("a", "b").alias("crossing"), F.count_distinct("id").alias("affected"))
    opening = F.concat(F.lit(f'{{"threshold": {threshold}, "n_pairs": '), F.col("pairs").cast("string"), F.lit(', "n_crossing": '), F.col("crossing").cast("string"), F.lit(', "n_affected": '), F.col("affected").cast("string"), F.lit(', "crossing_pairs": ['))
    like = F.round("correlation", 6)
    item = member(a=F.col("a"), b=F.col("b"), correlation=number(like), split_a=text(F.col("split_a")), split_b=text(F.col("split_b")))
    return document(crossing.select("a", "b", (-like).alias("last"), item.alias("item")), [F.col("last"), F.col("a"), F.col("b")], opening, "]}", n.crossJoin(affected))


def data_yaml(root: str, classes: dict[int, str]) -> str:
    """The training view's data.yaml. The key is `val`, the folder `valid`."""
    names = "".join(f"  {k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in sorted(classes.items()))
    return f"path: {json.dumps(root, ensure_ascii=False)}\ntrain: train/images\nval: valid/images\nnames:\n{names}"


def image_sets(assigned: DataFrame) -> DataFrame:
    """relative_path, line: the ids of each split in ImageSets/Main; `valid` is called `val` there. assigned: id, split."""
    name = F.when(F.col("split") == "valid", "val").otherwise(F.col("split"))
    return assigned.select(F.concat(F.lit("ImageSets/Main/"), name, F.lit(".txt")).alias("relative_path"), F.col("id").cast("string").alias("line"))


def write_image_sets(assigned: DataFrame, root: str) -> None:
    """A folder of text parts for each list, sorted by id within a part; a split of any size goes to many tasks."""
    rows = image_sets(assigned)
    rows.repartition("relative_path", F.pmod(F.xxhash64("line"), F.lit(64))).sortWithinPartitions("relative_path", "line").write.partitionBy("relative_path").mode("overwrite").text(root)
