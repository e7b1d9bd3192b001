"""Sharding by a k-d tree over text metadata, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, digest, ranked

_BITS, _STEP, _PASSES = 40, 12, 3


def of_dim(dim: Column) -> Column:
    """The value of the dimension with a number."""
    return F.when(dim == 0, F.col("d0")).when(dim == 1, F.col("d1")).otherwise(F.col("d2"))


def split(points: DataFrame, nodes: DataFrame, scratch: Scratch, level: int) -> DataFrame:
    """at, half, dim, below of every node with points: rows of box `at` with at least `below` in dimension `dim` go to box at + half.
    nodes: at, shards, the boxes of this level that are to hold several shards.

    A box is cut in the dimension in which it is widest, where its bytes are parted in the ratio of the shards on both sides. The
    place is found _STEP bits at a time, for all boxes at once; tables of boxes have a row a shard at most and are broadcast.
    """
    wide = points.join(F.broadcast(nodes), "at").groupBy("at").agg(F.first("shards").alias("shards"), F.sum("size").alias("bytes"), *[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"w{i}") for i in range(3)])
    most = F.greatest("w0", "w1", "w2")
    half = F.floor(F.col("shards") / 2)
    zero = F.lit(0).cast("long")
    state = wide.select("at", half.alias("half"), F.when(F.col("w0") == most, 0).when(F.col("w1") == most, 1).otherwise(2).alias("dim"), (F.col("bytes") * half / F.col("shards")).alias("goal"), zero.alias("prefix"), zero.alias("passed"), zero.alias("below"))
    state = scratch.write(state, f"state{level}")
    for k in range(_PASSES):
        low = _BITS - _STEP * (k + 1)
        own = points.join(F.broadcast(state), "at").withColumn("x", of_dim(F.col("dim"))).where(F.shiftright("x", low + _STEP) == F.col("prefix"))
        sums = own.groupBy("at", F.shiftright("x", low).alias("bin")).agg(F.sum("size").alias("n"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("at").orderBy("bin"))).join(F.broadcast(state), "at")
        hit = upto.where(F.col("upto") > F.col("goal") - F.col("passed")).groupBy("at").agg(F.min(F.struct("bin", "upto", "n")).alias("hit"))
        start = F.col("passed") + F.col("hit.upto") - F.col("hit.n")
        nearer_end = (start + F.col("hit.n") - F.col("goal") < F.col("goal") - start).cast("long")
        moved = state.drop("prefix", "below").join(hit, "at").select("at", "half", "dim", "goal", F.col("hit.bin").alias("prefix"), start.alias("passed"), F.shiftleft(F.col("hit.bin") + nearer_end, low).alias("below"))
        state = scratch.write(moved, f"state{level}-{k}")
    return state.select("at", "half", "dim", "below")


def shard(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row. Size is the text's UTF-8 bytes plus `overhead`.

    A k-d tree over (log2 of the size, bytes per character, characters per blank) halves the box with the weighted median of
    its widest dimension until each of the `shards` leaves has about the same bytes. The dimensions are functions of the
    text, so equal texts share a shard; a shard is off the mean by a few times the largest group of equal texts at most.
    Ties in a dimension are cut by bits of the text's hash. Null text has no bytes and counts as empty. Null ids and repeated
    rows get their own slots. An empty table gives no rows. Other columns are not read.

    The text is read once; a level of the tree is four aggregations over narrow rows: a box's spans, then 12 bits at a time
    of the median, all boxes at once. A row has its box in a column and learns of a cut by a broadcast join, so the plan of a level
    is the same for any number of shards. Slots are numbered within parts of a shard, shifted by a prefix sum of the parts' sizes.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + overhead
    chars = F.char_length(text)
    blanks = chars - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    raw = scratch.write(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), digest(text)[0].alias("h1"), F.log2(size).alias("d0"), ((F.octet_length(text) + 1) / (chars + 1)).alias("d1"), ((chars + 1) / (blanks + 1)).alias("d2")), "raw")
    names = ["d0", "d1", "d2"]
    ends = raw.agg(*[F.min(n).alias(f"lo{n}") for n in names], *[F.max(n).alias(f"hi{n}") for n in names]).first()

    def scaled(name: str) -> Column:
        lo, hi = ends[f"lo{name}"] or 0.0, ends[f"hi{name}"] or 0.0
        part = (F.col(name) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
        return F.shiftleft(F.floor(part * float(2**20 - 1)), 20) + F.shiftrightunsigned("h1", 44)

    points = scratch.write(raw.select("doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("row"), *[scaled(n).alias(n) for n in names], F.lit(0).cast("long").alias("at")), "points0")
    scratch.drop("raw")
    nodes, level = [(0, shards)], 0  # first shard and number of shards of a box
    while nodes := [n for n in nodes if n[1] > 1]:
        cut = split(points, docs.sparkSession.createDataFrame(nodes, "at long, shards long"), scratch, level)
        over = of_dim(F.col("dim")) >= F.col("below")
        points = scratch.write(points.join(F.broadcast(cut), "at", "left").withColumn("at", F.col("at") + F.when(over, F.col("half")).otherwise(0)).select(points.columns), f"points{level + 1}")
        scratch.drop(f"points{level}")
        nodes = [x for first, n in nodes for x in ((first, n // 2), (first + n // 2, n - n // 2))]
        level += 1
    placed = points.select("doc_id", "size", "text_crc32", "row", F.col("at").cast("int").alias("shard"))
    return ranked(placed, ["shard"], [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")], [F.col("row")], "slot").drop("row")
