"""Exact interpolated percentiles of groups of any size, without an aggregate that grows with the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: A sketch's ranks are right to one part in _ACCURACY; its size follows _ACCURACY, not the rows.
_ACCURACY = 10_000
_CUTS = 64


def _fewer(near: DataFrame, state: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values nearer to the ranks: those of the one or two of _CUTS parts of equal size that hold them, and the ranks within."""
    cuts = near.groupBy(*by).agg(F.percentile_approx("v", [i / _CUTS for i in range(1, _CUTS)], _ACCURACY).alias("cuts"))
    parts = written(near.join(cuts, by).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts"))
    sizes = parts.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("part")))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("part")))
    chosen = upto.join(state, by).groupBy(*by).agg(at("low").alias("first"), at("high").alias("last"))
    before = upto.join(chosen, by).groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("part") < F.col("first"), F.col("n"))), F.lit(0)).alias("below"))
    state = written(state.join(before, by).select(*by, "share", (F.col("low") - F.col("below")).alias("low"), (F.col("high") - F.col("below")).alias("high")))
    return written(parts.join(chosen, by).where("part between first and last").select(*by, "v")), state


def exact_percentiles(rows: DataFrame, keys: list[str], targets: dict[str, tuple[str, float]], most: int = 100_000, accuracy: int = _ACCURACY) -> DataFrame:
    """keys and a column for each of targets, {name: (column, p in 0 to 1)}: the percentile of the column's values that aren't
    null, interpolated between the two nearest; null for a key without values. Keys aren't null; without keys one row comes back.

    A sketch of bounded size (percentile_approx) gives two values between which a percentile surely lies; one more pass counts
    what is below and keeps what is between, some 4 / accuracy of the rows, and the nearest value on either side. While a group keeps more than `most` distinct values
    it is cut into parts of equal size, again by a sketch, and the part with the rank stays. The last window sees `most` values a
    group. Were a sketch ever off by more than twice what it promises, ranks would fall outside: then accuracy is raised.
    """
    by, gap = [*(keys or ["_all"]), "t"], 2 / accuracy
    names = list(targets)
    base = rows if keys else rows.withColumn("_all", F.lit(0))
    base = base.select(*by[:-1], *[F.col(targets[n][0]).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    ends = [F.percentile_approx(f"v{i}", [max(0.0, targets[n][1] - gap), min(1.0, targets[n][1] + gap)], accuracy).alias(f"e{i}") for i, n in enumerate(names)]
    groups = written(base.groupBy(*by[:-1]).agg(*ends, *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]))
    low, high = (lambda i: F.get(F.col(f"e{i}"), F.lit(0))), (lambda i: F.get(F.col(f"e{i}"), F.lit(1)))
    both = base.join(groups, by[:-1])
    aside = []
    for i in range(len(names)):
        v = F.col(f"v{i}")
        aside += [F.sum((v < low(i)).cast("long")).alias(f"b{i}"), F.max(F.when(v < low(i), v)).alias(f"p{i}"), F.min(F.when(v > high(i), v)).alias(f"a{i}")]
    below = written(both.groupBy(*by[:-1]).agg(*aside))  # how many are below, the nearest below and above

    def each(f) -> Column:
        return F.explode(F.array(*[f(i) for i in range(len(names))])).alias("x")

    near = both.select(*by[:-1], each(lambda i: F.struct(F.lit(i).alias("t"), F.when(F.col(f"v{i}").between(low(i), high(i)), F.col(f"v{i}")).alias("v"))))
    beside = below.select(*by[:-1], F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"{c}{i}").alias("v")) for i in range(len(names)) for c in "pa"])).alias("x"))
    near = written(near.unionByName(beside).select(*by[:-1], "x.t", "x.v").where("v is not null"))

    def ranks(i: int) -> Column:
        at, first = F.lit(targets[names[i]][1]) * (F.col(f"n{i}") - 1), F.col(f"b{i}") - F.col(f"p{i}").isNotNull().cast("long")
        return F.struct(F.lit(i).alias("t"), (at - F.floor(at)).alias("share"), (F.floor(at) - first).alias("low"), (F.ceil(at) - first).alias("high"), F.col(f"n{i}").alias("n"))

    state = groups.join(below, by[:-1]).select(*by[:-1], each(ranks)).select(*by[:-1], "x.*").where("n > 0").drop("n")
    state = written(state)
    counts = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("distinct"))
    outside = state.join(counts, by, "left").where("low < 0 or high >= coalesce(n, 0)")
    if outside.limit(1).count():
        if accuracy > 10**8:
            raise ArithmeticError("the sketch gave no bounds for a percentile")
        return exact_percentiles(rows, keys, targets, most, accuracy * 10)
    while counts.where(F.col("distinct") > most).limit(1).count():
        near, state = _fewer(near, state, by)
        counts = near.groupBy(*by).agg(F.approx_count_distinct("v").alias("distinct"))
    values = near.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("v")))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("v")))
    found = upto.join(state, by).groupBy(*by).agg(at("low").alias("a"), at("high").alias("b"), F.first("share").alias("share"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("share")
    wide = found.groupBy(*by[:-1]).agg(*[F.max(F.when(F.col("t") == i, value)).alias(n) for i, n in enumerate(names)])
    out = groups.select(*by[:-1]).join(wide, by[:-1], "left")
    return out if keys else out.drop("_all")
