"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch

_BROADCAST_ROWS = 100_000


def uniform(key: Column, seed: int) -> Column:
    """A repeatable number in (0, 1) for a key, from 52 bits of its md5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target. sizes has a row for each source.

    Water filling: with sources in the order of most * size / weight, the first source that its share of what the sources
    before it leave doesn't push over its limit sets the level for all after it. This is the fixed point of resharing.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": most * F.col("source_size"), "total": share * F.sum("source_size").over(Window.partitionBy())})
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = ranked.withColumns({
        "k": F.row_number().over(order),
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))
    return upto.withColumn("level", F.min(fits).over(Window.partitionBy())["level"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def by_length(text: Column) -> Column:
    """A priority: the binary digits of a text's number of words, so a text with twice the words has one more."""
    return F.length(F.bin(n_words(text)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, priority: Column | None = None, carry: tuple[str, ...] = (), few: int = 100_000) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row: how often the mix takes it. With `carry`, also row, a struct
    of these columns of the same row, so that nobody has to find rows again by id.

    Sizes are words. A source's target over its size gives whole copies, which all its documents get, and a rest in words.
    The rest is a Pareto sample: documents are ranked by their random odds over their inclusion odds and taken in that order
    until the rest is reached; the document at the edge is taken if that comes nearer. So a source misses its target by at
    most half of one document. Inclusion odds are `priority`, a positive column (the same for all if None), times one number a
    source; as the sample is filled up to its words, that number does not change the order and need not be found.
    Random numbers come from id and seed: reruns agree. Rows with one id follow each other in the order, by a hash of their text;
    of rows that are the same in both, any may be taken.
    Null text has no words and is taken in whole copies of 0 words; a null source is a source, the last. An empty table gives
    no rows. Other columns are not read.

    Ranking needs no task with a whole source: words are summed by source and 1/4096 of the ranking, and a prefix sum finds the
    cell with the edge. A cell of more than `few` rows is cut again, in the end by the hash of the text and by row, so a source
    whose rows all have one id is no hot task. Only the last cell's documents are ordered one by one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    x = (priority if priority is not None else F.lit(1.0)).cast("double")
    u = uniform(F.col(id_col), seed)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), x.alias("x"), (u / (1 - u) / x).alias("odds"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie"), *([F.struct(*carry).alias("row")] if carry else []))
    sized = scratch.write(sized.withColumn("tie_row", F.xxhash64(F.monotonically_increasing_id())), "sized")

    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("x").alias("scale"))
    wanted = targets(sizes.drop("scale"), weights, share, most).withColumnRenamed("source", "_s").join(sizes.select("source", "scale"), F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    edge = scratch.write(wanted.withColumn("whole", whole).withColumns({"rest": rest, "start": F.lit(0).cast("long")}), "plan")

    spread = F.col("odds") * F.col("scale")
    place = spread / (1 + spread)
    digits = [F.floor(place * 2**12), F.floor(place * 2**24), F.col("odds"), *(F.shiftright("tie", k) for k in (52, 40, 0)), *(F.shiftright("tie_row", k) for k in (52, 40))]

    def with_edge(edge: DataFrame, k: int) -> DataFrame:
        """All rows, with their first k digits as d0.. and those of their source's edge as e0.. (null if the source has none)."""
        side = F.broadcast(edge) if edge.count() <= _BROADCAST_ROWS else edge
        return sized.join(side, F.col("source").eqNullSafe(F.col("_s"))).withColumns({f"d{i}": digits[i] for i in range(k)})

    def in_cell(k: int) -> Column:
        return reduce(and_, (F.coalesce(F.col(f"d{i}") == F.col(f"e{i}"), F.lit(False)) for i in range(k)), F.lit(True))

    for k in range(len(digits)):
        inner = with_edge(edge, k + 1).where(in_cell(k))
        sums = inner.groupBy("_s", f"d{k}").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"), F.first("start").alias("base"))
        upto = F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy(f"d{k}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = sums.withColumn("at", F.col("base") + upto).where(F.col("at") < F.col("rest")).groupBy(F.col("_s").alias("_t")).agg(F.max(F.struct(f"d{k}", "at", "rows")).alias("last"))
        edge = edge.drop("rows").join(last, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
        edge = edge.withColumns({f"e{k}": F.col(f"last.d{k}"), "start": F.coalesce("last.at", "start"), "rows": F.col("last.rows")}).drop("last")
        edge = scratch.write(edge, f"edge{k}")
        if (edge.agg(F.max("rows")).first()[0] or 0) <= few:
            break

    ready = with_edge(edge, k + 1)
    own, at_edge = F.struct(*(f"d{i}" for i in range(k + 1))), F.struct(*(f"e{i}" for i in range(k + 1)))
    close = F.col("e0").isNotNull() & in_cell(k + 1)
    clear = ready.where(~close).withColumn("extra", F.coalesce(F.col("e0").isNotNull() & (own < at_edge), F.lit(False)).cast("long"))
    order = Window.partitionBy("source").orderBy("odds", "tie", "tie_row").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    edged = ready.where(close).withColumn("extra", (2 * at + F.col("size") <= 2 * F.col("rest")).cast("long"))
    copies = F.col("whole") + F.col("extra")
    return clear.unionByName(edged).select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))
