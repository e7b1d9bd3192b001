"""Frozen splits and folds by group, their extension, and integrity checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import PARAMS

SPLITS = ("train", "valid", "test")


def group_key(strategy: str, sample: Column, *, directory: Column | None = None, regex: str | None = None, manifest: Column | None = None) -> Column:
    """The group of a sample: itself, its directory, the manifest's entry, or the first capture of a pattern in its name."""
    if strategy == "none":
        return sample
    if strategy == "directory":
        return directory
    if strategy == "manifest":
        return F.coalesce(manifest, F.raise_error(F.concat(F.lit("not in the manifest: "), sample)))
    if strategy == "prefix":
        found = F.regexp_extract(sample, regex, 1)
        return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no group in the name: "), sample)))
    raise ValueError(f"unknown strategy {strategy!r}")


def shuffle_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def random_split(samples: DataFrame, ratios=PARAMS.ratios, seed: int = PARAMS.seed) -> DataFrame:
    """id, grp, split: whole groups in the order of md5(seed:group), cut at half-even round(total * ratio). samples: id, grp.

    Only the cuts need the number of groups; a group's place is its rank among hashes, found by ranges of the hash: a prefix
    sum over 4096 ranges, then a rank inside one, so no task ranks all groups.
    """
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    groups = samples.select("grp").distinct().withColumn("h", shuffle_order(F.col("grp"), seed)).withColumn("range", F.substring("h", 1, 3))
    sizes = groups.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(every).alias("total"))
    placed = groups.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy("h", "grp"))).join(starts, "range")
    at, total = F.col("start") + F.col("own"), F.col("total")
    train = F.least(F.bround(total * ratios[0]), total)
    valid = F.least(F.bround(total * ratios[1]), total - train)
    split = F.when(at <= train, "train").when(at <= train + valid, "valid").otherwise("test")
    return samples.join(placed.select("grp", split.alias("split")), "grp").select("id", "grp", "split")


def create_split(samples: DataFrame, strategy: str, *, regex: str | None = None, manifest: DataFrame | None = None, independence_confirmed: bool = False, ratios=PARAMS.ratios, seed: int = PARAMS.seed) -> DataFrame:
    """id, grp, split of a new split by group (see group_key). samples: id, and directory for that strategy; manifest: id, grp.

    Options are checked before anything is read. Without groups each sample is taken as independent of all others; as takes of one
    thing in two splits make results look better than they are, that has to be confirmed."""
    if strategy == "none" and not independence_confirmed:
        raise ValueError("strategy none takes every sample as independent: confirm it with independence_confirmed, or name a group")
    if strategy == "prefix" and (not regex or re.compile(regex).groups != 1):
        raise ValueError("strategy prefix needs a pattern with one capture, the group")
    if strategy == "manifest" and manifest is None:
        raise ValueError("strategy manifest needs a manifest of id and grp")
    rows = samples
    if strategy == "manifest":
        rows = samples.join(manifest.select("id", F.col("grp").alias("_grp")), "id", "left")
    given = {"directory": F.col("directory")} if strategy == "directory" else {"manifest": F.col("_grp")} if strategy == "manifest" else {}
    return random_split(rows.select("id", group_key(strategy, F.col("id"), regex=regex, **given).alias("grp")), ratios, seed)


def extend_splits(samples: DataFrame, known: DataFrame, ratios=PARAMS.ratios, seed: int = PARAMS.seed + 1, adopted: DataFrame | None = None) -> DataFrame:
    """id, grp, split, how for samples that aren't known: the split of their group if it has one, else that of their folder
    (adopted: id, split), else a fresh cut. samples: id, grp; known: id, split. Known samples stay where they are."""
    new = samples.join(known.select("id"), "id", "left_anti")
    of_group = samples.join(known, "id").groupBy("grp").agg(F.min("split").alias("split"))
    out = new.join(of_group, "grp").select("id", "grp", "split", F.lit("inherited").alias("how"))
    rest = new.join(of_group, "grp", "left_anti")
    if adopted is not None:
        out = out.unionByName(rest.join(adopted.select("id", "split"), "id").select("id", "grp", "split", F.lit("directory").alias("how")))
        rest = rest.join(adopted.select("id"), "id", "left_anti")
    return out.unionByName(random_split(rest, ratios, seed).withColumn("how", F.lit("fresh")))


def level_folds(histogram: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each group size, from the largest: runs (fold, n) in the order in which its groups go to the smallest fold.

    Within one size s, m groups go to the m least (load_i + j * s, i): the same as one by one. A run is taken in rounds once
    loads are within s of each other, so the driver's work follows the number of sizes, not of groups.
    """
    load = [0] * k
    out = []
    for size, m in histogram:
        runs: list[tuple[int, int]] = []
        while m and (max(load) - min(load) >= size or m < k):
            i = min(range(k), key=lambda f: (load[f], f))
            n = 1
            others = sorted((load[f], f) for f in range(k) if f != i)
            if others:
                gap = others[0][0] - load[i]
                n = max(1, min(m, gap // size))
            runs.append((i, min(n, m)))
            load[i] += size * min(n, m)
            m -= min(n, m)
        if m >= k:
            order = sorted(range(k), key=lambda f: (load[f], f))
            rounds = m // k
            runs.append((-1, rounds))
            runs[-1] = (tuple(order), rounds)  # type: ignore[assignment]
            load = [x + size * rounds for x in load]
            m -= rounds * k
            while m:
                i = min(range(k), key=lambda f: (load[f], f))
                runs.append((i, 1))
                load[i] += size
                m -= 1
        out.append(runs)
    return out


def grouped_folds(samples: DataFrame, k: int = PARAMS.folds) -> DataFrame:
    """id, grp, fold: groups by descending size, then key, each to the smallest fold. samples: id, grp.

    The driver sees the histogram of group sizes. A group's place within its size decides its fold. The seed of a shuffle
    before would have no effect, as the order is total.
    """
    spark = samples.sparkSession
    sizes = samples.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    histogram = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()]
    rows = []
    for (size, _), runs in zip(histogram, level_folds(histogram, k), strict=True):
        at = 0
        for fold, n in runs:
            folds = list(fold) if isinstance(fold, tuple) else [fold]
            rows.append((size, at, at + n * len(folds), folds))
            at += n * len(folds)
    plan = spark.createDataFrame(rows, "p_size long, lo long, hi long, folds array<int>")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy("grp")) - 1)
    on = (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    fold = F.get("folds", ((F.col("rank") - F.col("lo")) % F.size("folds")).cast("int"))
    return samples.join(ranked.join(plan, on).select("grp", fold.alias("fold")), "grp").select("id", "grp", "fold")


def integrity(samples: DataFrame, assigned: DataFrame) -> DataFrame:
    """id, problem: assigned but absent, or present but unassigned."""
    gone = assigned.select("id").join(samples.select("id"), "id", "left_anti").withColumn("problem", F.lit("absent"))
    return gone.unionByName(samples.select("id").join(assigned.select("id"), "id", "left_anti").withColumn("problem", F.lit("unassigned")))


def clashes(assigned: DataFrame, key: str) -> DataFrame:
    """Keys (samples or groups) in more than one split."""
    return assigned.groupBy(key).agg(F.count_distinct("split").cast("long").alias("splits")).where("splits > 1")


def load_split(assigned: DataFrame, split: str, *, allow_test: bool = False) -> DataFrame:
    """The samples of a split. The test split is sealed: it opens only if asked for by name and allowed."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    if split == "test" and not allow_test:
        raise PermissionError("the test split is sealed")
    return assigned.where(F.col("split") == split)
