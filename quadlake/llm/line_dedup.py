"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, digest, n_partitions


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case. lower() is the fast way where all characters are ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


class Runs:
    """Sorted runs of (h1, h2, n), n the number of documents with the line, as in a log-structured merge tree.

    A run is a table bucketed and sorted by hash, so that merging or anti-joining runs moves nothing between tasks. A new
    batch is merge-anti-joined with the saturated run (lines that already have `least` documents: more can't change what
    happens to them) and the rest becomes a run of level 0. `fanout` runs of a level are compacted into one of the next;
    lines that reach `least` there move to the saturated run.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, least: int, fanout: int = 2):
        self.spark, self.scratch, self.least, self.fanout = spark, scratch, least, fanout
        self.levels: list[list[str]] = []
        self.saturated: str | None = None
        self.name = f"quadlake_runs_{uuid.uuid4().hex[:12]}"
        self.made = 0
        self.buckets = n_partitions(spark)

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        writer = df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.scratch.path(name))
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
        return name

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.drop(name)

    def add(self, batch: DataFrame) -> None:
        if self.saturated:
            batch = batch.join(self.spark.table(self.saturated).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.push(0, self.write(batch))

    def push(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self.push(level + 1, self.compact(runs))

    def compact(self, runs: list[str]) -> str:
        merged = self.spark.table(runs[0])
        for r in runs[1:]:
            merged = merged.unionByName(self.spark.table(r))
        out = self.write(merged.groupBy("h1", "h2").agg(F.sum("n").alias("n")))
        self.drop(runs)
        full = self.spark.table(out).where(F.col("n") >= self.least)
        old, self.saturated = self.saturated, self.write(full.unionByName(self.spark.table(self.saturated)) if self.saturated else full)
        rest = self.write(self.spark.table(out).where(F.col("n") < self.least))
        self.drop([out, *([old] if old else [])])
        return rest

    def finish(self) -> DataFrame:
        """The lines that have at least `least` documents over all batches, as a plain table; the runs go."""
        if left := [r for level in self.levels for r in level]:
            self.levels = [[self.compact(left)]]
        full = self.scratch.write(self.spark.table(self.saturated).select("h1", "h2"), "full")
        self.drop([self.saturated, *[r for level in self.levels for r in level]])
        return full


def frequent_lines(docs: DataFrame, scratch: Scratch, text_col: str, least: int, batches: int) -> DataFrame:
    spark = docs.sparkSession
    bare = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), line_key))
    lines = docs.select(F.pmod(F.xxhash64(text_col), F.lit(batches)).cast("int").alias("batch"), F.explode(bare).alias("key")).where(F.col("key") != "")
    counted = lines.select("batch", *digest(F.col("key"))).groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    runs = Runs(spark, scratch, least)
    fresh = runs.write(counted, ("batch",))
    for b in range(batches):
        runs.add(spark.table(fresh).where(F.col("batch") == b).select("h1", "h2", "n"))
    runs.drop([fresh])
    return runs.finish()


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 4) -> DataFrame:
    """The rows of docs with n_lines, n_dropped and kept_text: lines whose key is in at least `least` documents are dropped.

    Lines are split at \\n; the key is the line without blanks at its ends and with A-Z in lower case; lines with an empty key
    stay. Every row is a document, so repeated rows count as often as they stand there. Null text is one empty line. Columns
    of docs named n_lines, n_dropped or kept_text are replaced; other columns may have any name. An empty table gives no rows.

    Each document sends a line's 128-bit hash once; the counts combine before they are shuffled, so a line that all documents
    have is one row for each task. The frequent lines come from levelled sorted runs (Runs). Positions of frequent lines are
    found by a join on the hash (split where a line is hot), gathered by document, and meet the text in one join.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    own = "_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    full = frequent_lines(docs, scratch, text_col, least, batches)
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = digest(text)
    hit = (
        docs.select(F.col(id_col).alias(own + "_id"), t1.alias(own + "_t1"), t2.alias(own + "_t2"), F.posexplode(F.split(text, "\n")).alias(own + "_pos", own + "_line"))
        .withColumn(own + "_line", line_key(F.col(own + "_line")))
        .where(F.col(own + "_line") != "")
        .select(own + "_id", own + "_t1", own + "_t2", own + "_pos", *digest(F.col(own + "_line")))
        .join(full, ["h1", "h2"], "left_semi")
        .groupBy(own + "_id", own + "_t1", own + "_t2")
        .agg(F.collect_set(own + "_pos").alias(own + "_drop"))
    )
    hit = scratch.write(hit, "hit")
    base = docs.drop("n_lines", "n_dropped", "kept_text").withColumns({own + "_u1": t1, own + "_u2": t2})
    out = base.join(hit, F.col(id_col).eqNullSafe(F.col(own + "_id")) & (F.col(own + "_u1") == F.col(own + "_t1")) & (F.col(own + "_u2") == F.col(own + "_t2")), "left")
    lines = F.split(text, "\n")
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own + "_drop")))
    kept = F.when(F.col(own + "_drop").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(own + "_drop"), F.lit(0)).cast("long"), "kept_text": kept}).drop(own + "_u1", own + "_u2", own + "_id", own + "_t1", own + "_t2", own + "_drop")
