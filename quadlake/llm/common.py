"""Helpers that the corpus operators share: scratch tables, text keys and ranks without hot tasks."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a new
    temporary folder; on a cluster executors would write to their own disks, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quadlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, so a lost executor costs a read, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df and reads it again."""
        schema = df.schema
        with shuffles_removed(self.spark):
            df.write.partitionBy(*partition_by).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def content_key(*parts) -> str:
    """Names what a worker's cache was made from by its content: ids of objects are used again."""
    return hashlib.sha256(pickle.dumps(parts, protocol=5)).hexdigest()


_held: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks. It is one thing at a time: Spark uses workers again, and the caches of one step
    shall not stand beside those of the step before."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in smaller parts, so that what a task makes of one is small."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def digest(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text: 128 bits name it."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: list[Column], rank: str = "rank", parts: int | None = None) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, in any but a repeatable order, without a hot task.

    Rows are dealt to `parts` sub-groups by a hash of `spread`. Each sub-group is numbered by itself; a prefix sum over the
    (few) sub-group sizes of a key shifts the numbers. No task gets more than a key's share over `parts`.
    """
    parts = parts or max(64, n_partitions(df.sparkSession))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    by = [F.col(k) for k in keys]
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[c.alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1)
    on = [c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    out = own.join(shifts, [*on, F.col("_part") == F.col("_p")])
    return out.withColumn(rank, F.col("_shift") + F.col("_own")).drop("_part", "_p", "_own", "_shift", *[f"_k{i}" for i in range(len(by))])


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """rows joined with `one`, a table with one row a key whose column n says how many of rows have the key. Keys with more than
    1/share of the rows are fewer than `share`: those are broadcast, and the others joined by a shuffle without a hot key.
    Keys are not null."""
    most = rows.count() // share
    hot = F.broadcast(one.where(F.col(n) > most))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(one.where(F.col(n) <= most).hint("merge"), keys))
