"""Near-duplicates by correlation of signatures, their groups, and leakage across splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..scratch import shared_root, written


def centered_unit(v: Column) -> Column:
    """An array less its mean, with norm 1; a constant array gives zeros."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    off = let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))
    norm = lambda o: F.sqrt(total(F.transform(o, lambda x: x * x)))
    return let(off, lambda o: let(norm(o), lambda n: F.transform(o, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


_BLOCK_ROWS = 5000
_PIVOTS = 4096
#: Slack for angles in floating point.
_EPS = 1e-6


def _angles(sig: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sig @ pivots.T, -1.0, 1.0))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy()
    return flat.reshape(len(column), -1)


def dealt(signatures: DataFrame, threshold: float, block_rows: int = _BLOCK_ROWS, pivots: int = _PIVOTS) -> DataFrame:
    """lo, hi, block, id, sig: each row for every pair of blocks that it must be compared in.

    Rows are dealt to cells by their nearest pivot (the rows with the smallest hash are pivots), a cell of more than `block_rows`
    to several blocks by a hash. On the sphere of unit vectors angles obey the triangle inequality: with `reach` the angle of
    the threshold, a row at angle a from its own pivot can have a partner in another cell only if it is within a + 2 reach of
    that cell's pivot, and within the cell's radius + reach. So a row meets its own cell's blocks and those of the cells that
    this leaves. Pivots, radii and sizes (`pivots` at most) are on the driver. Data without any structure, where all angles
    are alike, leave every cell, and then all pairs of blocks are compared; close groups leave few.
    """
    n = signatures.count()
    reach = np.pi if threshold <= 0 else float(np.arccos(min(1.0, threshold))) + _EPS
    chosen = signatures.select("id", "sig", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(min(pivots, max(8, -(-n // block_rows)))).collect()
    centres = np.array([r["sig"] for r in chosen], float)
    kind = signatures.schema["id"].dataType.simpleString()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = _angles(_vectors(batch.column(1)), centres)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], names=["id", "sig", "cell", "angle"])

    homes = written(signatures.select("id", "sig").mapInArrow(home, f"id {kind}, sig array<double>, cell int, angle double"))
    radius, blocks = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    for r in homes.groupBy("cell").agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], blocks[r["cell"]] = r["a"], -(-r["n"] // block_rows)
    first = np.cumsum(blocks) - blocks

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                angle, cell = _angles(_vectors(batch.column(1)), centres), batch.column(2).to_numpy()
                meets = (angle <= radius + reach) & (angle <= batch.column(3).to_numpy()[:, None] + 2 * reach) & (blocks > 0)
                meets[np.arange(len(cell)), cell] = True
                own = first[cell] + batch.column(4).to_numpy() % blocks[cell]
                row, other = np.nonzero(meets)
                each = blocks[other]
                at = np.repeat(row, each)
                to = np.repeat(first[other], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[at], to)), pa.array(np.maximum(own[at], to)), pa.array(own[at]), batch.column(0).take(pick), batch.column(1).take(pick)], names=["lo", "hi", "block", "id", "sig"])

    return homes.withColumn("h", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2**31))).mapInArrow(send, f"lo long, hi long, block long, id {kind}, sig array<double>")


def near_pairs(signatures: DataFrame, threshold: float, block_rows: int = _BLOCK_ROWS, pivots: int = _PIVOTS) -> DataFrame:
    """a, b (a < b), correlation of all pairs strictly over the threshold. signatures: id (unique), sig (unit vectors of one size;
    zeros, of constant inputs, correlate with nothing).

    Exact: no pair over the threshold is lost. Rows meet in blocks, those of cells that are too far apart never (see dealt); a
    task multiplies the matrices of two blocks.
    """
    some = F.exists("sig", lambda x: x != 0) if threshold >= 0 else F.lit(True)
    sent = dealt(signatures.select("id", "sig").where(some), threshold, block_rows, pivots)

    def multiply(table: pa.Table) -> pa.Table:
        at, lo, hi = table.column("block").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        ids, sigs = table.column("id").to_numpy(), _vectors(table.column("sig"))
        left, right = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        out = []
        for k in range(0, len(left), 1024):
            c = sigs[left[k : k + 1024]] @ sigs[right].T
            i, j = np.nonzero(c > threshold)
            a, b = ids[left[k + i]], ids[right[j]]
            keep = a < b if lo == hi else a != b
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], c[i, j][keep]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "correlation": pa.array(c, pa.float64())})

    return sent.groupBy("lo", "hi").applyInArrow(multiply, "a long, b long, correlation double")


def groups(pairs: DataFrame) -> DataFrame:
    """id, label: connected components named by their least id. Least labels around, then labels of labels, until no change;
    each round is checkpointed to the shared folder."""
    spark = pairs.sparkSession
    spark.sparkContext.setCheckpointDir(shared_root(spark))
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).checkpoint()
    labels = edges.groupBy(F.col("u").alias("id")).agg(F.least(F.col("u"), F.min("v")).alias("label")).checkpoint()
    while True:
        around = edges.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        near = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("near"))
        up = labels.select(F.col("id").alias("near"), F.col("label").alias("up"))
        new = near.join(up, "near").select("id", "label", F.least("near", "up").alias("to")).checkpoint()
        moved = new.where("to <> label").limit(1).count()
        labels = new.select("id", F.col("to").alias("label"))
        if not moved:
            return labels


def leakage(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """Pairs whose ends are in different splits. splits: id, split."""
    s = lambda k, n: splits.select(F.col("id").alias(k), F.col("split").alias(n))
    return pairs.join(s("a", "split_a"), "a").join(s("b", "split_b"), "b").where("split_a <> split_b")


def leakage_by_split(crossing: DataFrame) -> DataFrame:
    """split, pairs, images: crossing pairs that touch a split, and its affected images."""
    ends = crossing.select("a", "b", F.explode(F.array(F.struct(F.col("split_a").alias("split"), F.col("a").alias("id")), F.struct(F.col("split_b").alias("split"), F.col("b").alias("id")))).alias("e"))
    return ends.groupBy("e.split").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("e.id").alias("images"))
