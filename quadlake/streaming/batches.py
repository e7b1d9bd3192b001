"""Frozen splits and the log of test accesses, kept up by streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import exists
from ..operators.splits import shuffle_order
from ..params import PARAMS
from ..sources.labels import read_test_accesses


def into_batches(stream: DataFrame, root: str, checkpoint: str, make: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Reads what has arrived and stops. Each batch's result is a folder of its own below root, named by the batch's number.

    make(batch, earlier) gives the result from the rows of the batch and the results of the batches before it (None for the first).
    A batch that runs again, after a failure, sees the same and replaces its own folder: nothing is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [p for k in range(number) if exists(spark, p := f"{root}/batch={k}")]
        make(batch, spark.read.parquet(*before) if before else None).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hashed_split(grp: Column, ratios=PARAMS.ratios, seed: int = PARAMS.seed + 1) -> Column:
    """A group's split by the place of its hash between 0 and 1. A stream never knows how many groups there are, so the cut at a
    share of the groups (random_split) isn't to be had; this one is the same in whatever batches groups arrive."""
    at = F.conv(F.substring(shuffle_order(grp, seed), 1, 8), 16, 10).cast("long") / float(2**32)
    return F.when(at < ratios[0], "train").when(at < ratios[0] + ratios[1], "valid").otherwise("test")


def extend_splits(arriving: DataFrame, frozen: DataFrame, root: str, checkpoint: str, ratios=PARAMS.ratios, seed: int = PARAMS.seed + 1) -> StreamingQuery:
    """Keeps id, grp, split of arriving samples below root. arriving: a stream of id, grp; frozen: id, grp, split of the samples that
    had a split before. A sample that has one already is left out, so arrivals may repeat; a new one takes its group's split,
    or, if the group is new too, that of the group's hash."""

    def make(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        known = frozen.select("id", "grp", "split") if earlier is None else frozen.select("id", "grp", "split").unionByName(earlier)
        new = batch.select("id", "grp").dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
        of_group = known.groupBy("grp").agg(F.min("split").alias("own"))
        return new.join(of_group, "grp", "left").select("id", "grp", F.coalesce("own", hashed_split(F.col("grp"), ratios, seed)).alias("split"))

    return into_batches(arriving, root, checkpoint, make)


def follow_accesses(lines: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keeps utc, run, reason, readable of the access log's lines (a stream of column value) below root."""
    return into_batches(lines, root, checkpoint, lambda batch, _: read_test_accesses(batch.select("value")))
