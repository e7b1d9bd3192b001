"""Bootstrap over images without a row for each replicate and image.

Images are numbered in the order of a hash and stand in blocks. A replicate's n draws are dealt to blocks by one hash, counted in
the map; inside a block another hash deals a block's draws to its images. So a task draws for one block, for all replicates at
once, and what it sends is a vector of partial sums with a number for each replicate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import PARAMS
from ..scratch import written
from .detection import mean_of_envelope, ranged

BLOCK = 4096
#: Rows of a range of the ranking: a task holds two numbers for each of its rows and replicates.
VECTOR_ROWS = 2000
_PART_ROWS = 50_000


def _hashed(*parts) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def placed(units: DataFrame, n: int, block: int) -> DataFrame:
    """Adds block and at, the place of each row within it. Places follow the order of md5(image_id), image_id; rows are numbered in
    parts by the first digits of the hash, after a prefix sum over the parts' sizes. units: one row an image."""
    digits = 1
    while 16**digits * _PART_ROWS < n:
        digits += 1
    hashed = units.withColumn("_md5", F.md5(F.col("image_id").cast("string"))).withColumn("_part", F.substring("_md5", 1, digits))
    sizes = hashed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_md5", "image_id")) - 1
    place = (F.col("_own") + F.col("_start")).cast("long")
    out = hashed.withColumn("_own", own).join(starts, "_part").withColumn("_place", place)
    return out.withColumns({"block": F.floor(F.col("_place") / block), "at": F.col("_place") % block}).drop("_md5", "_part", "_own", "_start", "_place")


def hits(units: DataFrame, n: int, samples: int, seed: int, block: int) -> DataFrame:
    """block, hits: how many of each replicate's n draws fall into the block, an array with a number for each replicate."""
    spark = units.sparkSession
    every = F.array(*[F.lit(n).cast("long")] * samples) if n <= block else None
    if every is not None:
        return spark.range(1).select(F.lit(0).cast("long").alias("block"), every.alias("hits"))
    chunks = -(-n // block)
    first = (F.col("id") % chunks) * block
    draws = spark.range(samples * chunks).select(F.floor(F.col("id") / chunks).alias("rep"), F.explode(F.sequence(first, F.least(first + block, F.lit(n)) - 1)).alias("j"))
    fell = draws.select("rep", F.floor(_hashed("rep", "j", F.lit(str(seed))) % n / block).alias("block")).groupBy("block", "rep").agg(F.count(F.lit(1)).alias("n"))
    some = fell.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("rep", "n"))).alias("of"))
    return some.select("block", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long")), lambda r: F.coalesce(F.try_element_at("of", r), F.lit(0).cast("long"))).alias("hits"))


def drawn(block: int, size: int, own_hits: np.ndarray, seed: int) -> np.ndarray:
    """How often each image of a block is drawn (across) in each replicate (down)."""
    out = np.zeros((len(own_hits), size), np.uint16)
    end = f":{seed}".encode()
    for rep, m in enumerate(own_hits.tolist()):
        head = f"{rep}:{block}:".encode()
        at = np.fromiter((int(hashlib.md5(head + str(d).encode() + end).hexdigest()[:15], 16) for d in range(m)), np.int64, m)
        out[rep] = np.bincount(at % size, minlength=size)
    return out


def _block_of(table: pa.Table, found: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray]:
    at = table.column("at").to_numpy()
    return at, drawn(table.column("block")[0].as_py(), int(at.max()) + 1, found.column("hits").combine_chunks()[0].values.to_numpy(), seed)


def bootstrap_mean(units: DataFrame, samples: int = PARAMS.bootstrap_samples, seed: int = PARAMS.seed, block: int = BLOCK) -> DataFrame:
    """rep, value: the mean of value over each replicate's draws. units: image_id, value, one row an image."""
    n = units.count()
    rows = placed(units.select("image_id", "value"), n, block)

    def sums(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return pa.table({"sums": pa.array([], pa.list_(pa.float64()))})
        at, times = _block_of(table, found, seed)
        value = np.zeros(times.shape[1])
        value[at] = table.column("value").to_numpy()
        return pa.table({"sums": pa.array([times @ value], pa.list_(pa.float64()))})

    parts = rows.groupBy("block").cogroup(hits(units, n, samples, seed, block).groupBy("block")).applyInArrow(sums, "sums array<double>")
    return parts.select(F.posexplode("sums").alias("rep", "s")).groupBy("rep").agg((F.sum("s") / max(n, 1)).alias("value")).select(F.col("rep").cast("long").alias("rep"), "value")


def bootstrap_ap(rows: DataFrame, units: DataFrame, samples: int = PARAMS.bootstrap_samples, seed: int = PARAMS.seed, block: int = BLOCK, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """rep, ap: the average precision of each replicate, an image that is drawn k times counting k times; rep -1 has each image
    once. NaN where a replicate has no truths. rows: image_id, pred_idx, score, hit; units: image_id, truths, one row an image.

    A row travels once, with the vector of its image's numbers. Rows are cut into ranges of the ranking; a first pass adds up
    ranges (a number a range and replicate), prefix sums give where each range starts, and a second pass finds the best precision
    for each replicate and recall point inside a range.
    """
    n = units.count()
    own = placed(units.select("image_id", "truths"), n, block)
    nested = rows.groupBy("image_id").agg(F.collect_list(F.struct("pred_idx", "score", "hit")).alias("rows"))
    kind = {f: t for f, t in rows.dtypes}

    def vectors(table: pa.Table, found: pa.Table) -> pa.Table:
        row = table.schema.field("rows").type.value_type
        loose = pa.list_(pa.field("element", pa.struct([pa.field(f.name, f.type) for f in row])))  # as Spark declares them
        table = table.set_column(table.schema.get_field_index("rows"), "rows", table.column("rows").cast(loose))
        if not table.num_rows or not found.num_rows:
            return pa.table({"image_id": table.column("image_id"), "truths": table.column("truths"), "rows": table.column("rows"), "times": pa.nulls(table.num_rows, pa.binary())}).slice(0, 0)
        at, times = _block_of(table, found, seed)
        once = np.concatenate([np.ones((1, times.shape[1]), np.uint16), times])
        each = [np.ascontiguousarray(once[:, k]).astype("<u2").tobytes() for k in at]
        return pa.table({"image_id": table.column("image_id"), "truths": table.column("truths"), "rows": table.column("rows"), "times": pa.array(each, pa.binary())})

    shape = f"image_id {kind['image_id']}, truths long, rows array<struct<pred_idx:{kind['pred_idx']},score:{kind['score']},hit:{kind['hit']}>>, times binary"
    blocks = own.join(nested, "image_id", "left").withColumn("truths", F.col("truths").cast("long")).groupBy("block")
    images = written(blocks.cogroup(hits(units, n, samples, seed, block).groupBy("block")).applyInArrow(vectors, shape))

    def add(batches):
        total = np.zeros(samples + 1, np.int64)
        for batch in batches:
            for truths, times in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += truths * np.frombuffer(times.as_buffer(), "<u2")
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["truths"])

    truths = images.select("truths", "times").mapInArrow(add, "truths array<long>").select(F.posexplode("truths").alias("rep", "t")).groupBy("rep").agg(F.sum("t").alias("n_truths"))
    all_truths = truths.agg(F.sort_array(F.collect_list(F.struct("rep", "n_truths"))).alias("a")).select(F.col("a.n_truths").alias("all"))
    ranked = ranged(images.select("image_id", "times", F.explode("rows").alias("r")).select("image_id", "r.*", "times"), [], vector_rows)

    def times_of(table: pa.Table) -> np.ndarray:
        return np.stack([np.frombuffer(x.as_buffer(), "<u2") for x in table.column("times").combine_chunks()]).astype(np.int64)

    def total(table: pa.Table) -> pa.Table:
        t, hit = times_of(table), table.column("hit").to_numpy().astype(np.int64)
        return pa.table({"_range": table.column("_range").slice(0, 1), "tp": pa.array([hit @ t], pa.list_(pa.int64())), "seen": pa.array([t.sum(axis=0)], pa.list_(pa.int64()))})

    sums = written(ranked.groupBy("_range").applyInArrow(total, "_range int, tp array<long>, seen array<long>"))
    before = Window.partitionBy("rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    long = sums.select("_range", F.posexplode(F.arrays_zip("tp", "seen")).alias("rep", "s"))
    starts = long.select("_range", "rep", *[F.coalesce(F.sum(f"s.{c}").over(before), F.lit(0)).alias(c) for c in ("tp", "seen")])
    starts = starts.groupBy("_range").agg(F.sort_array(F.collect_list(F.struct("rep", "tp", "seen"))).alias("a"))
    starts = starts.select("_range", F.col("a.tp").alias("tp"), F.col("a.seen").alias("seen")).crossJoin(all_truths)

    def best(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("image_id", "ascending"), ("pred_idx", "ascending")])
        t, hit = times_of(table), table.column("hit").to_numpy().astype(np.int64)
        at = {c: start.column(c).combine_chunks()[0].values.to_numpy() for c in ("tp", "seen", "all")}
        tp, seen = np.cumsum(t * hit[:, None], axis=0) + at["tp"], np.cumsum(t, axis=0) + at["seen"]
        some = (t > 0) & (at["all"] > 0)
        k, rep = np.nonzero(some)
        precision, recall = tp[some] / seen[some], tp[some] / at["all"][rep]
        point = np.append(np.arange(100) * 0.01, 1.0)
        last = np.searchsorted(point, recall, side="right") - 1
        key, inverse = np.unique(rep * 101 + last, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, inverse, precision)
        return pa.table({"rep": pa.array(key // 101, pa.int64()), "last": pa.array(key % 101, pa.int64()), "precision": pa.array(most)})

    found = ranked.groupBy("_range").cogroup(starts.groupBy("_range")).applyInArrow(best, "rep long, last long, precision double")
    ap = mean_of_envelope(found.groupBy("rep", "last").agg(F.max("precision").alias("precision")), ["rep"])
    out = truths.join(ap, "rep", "left")
    return out.select((F.col("rep") - 1).cast("long").alias("rep"), F.when(F.col("n_truths") > 0, F.coalesce("ap", F.lit(0.0))).otherwise(F.lit(float("nan"))).alias("ap"))
