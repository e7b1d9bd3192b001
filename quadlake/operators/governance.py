"""Licence and provenance verdicts of runs, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..params import COPYLEFT


def copyleft(license: Column) -> Column:
    return license.isin(*COPYLEFT)


def blockers(role: Column, name: Column, license: Column, ready: Column, sources: Column) -> Column:
    """Why a component can't go to production, as an array."""
    one = lambda c, t: F.when(c, t)
    fixed = F.array(
        one(~ready, F.concat(role, F.lit(" "), name, F.lit(" is not production ready (licence "), license, F.lit(")"))),
        one(copyleft(license), F.concat(role, F.lit(" "), name, F.lit(" has licence "), license)),
    )
    from_sources = F.transform(F.filter(sources, copyleft), lambda s: F.concat(role, F.lit(" "), name, F.lit(" has a source with licence "), s))
    return F.concat(F.array_compact(fixed), from_sources)


def verdicts(runs: DataFrame, components: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """Runs with license_blockers, production_ready, provenance_blockers and reproducible. components: component_id, name,
    license, production_ready, sources; chain: run_id, place, dataset_id, the datasets of a run in order (None: its dataset_id).

    A run is ready if its detector is and nothing in the chain is in the way: a dataset that isn't ready, its licence, or that of
    one of its sources."""
    none = F.array().cast("array<string>")
    d = components.select(*[F.col(c).alias(f"d_{c}") for c in components.columns])
    out = runs.join(d, F.col("detector_id") == F.col("d_component_id"), "left")
    detector = F.when(F.col("d_component_id").isNull(), F.array(F.lit("no detector is declared"))).otherwise(blockers(F.lit("detector"), F.col("d_name"), F.col("d_license"), F.col("d_production_ready"), F.col("d_sources")))
    links = chain if chain is not None else runs.select("run_id", F.lit(0).alias("place"), "dataset_id")
    used = links.join(components, F.col("dataset_id") == F.col("component_id"))
    bad = ~F.col("production_ready") | copyleft(F.col("license")) | F.exists("sources", copyleft)
    why = blockers(F.lit("dataset"), F.col("name"), F.col("license"), F.col("production_ready"), F.col("sources"))
    whole = used.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "dataset_id", why.alias("why")))).alias("links"), F.max(bad).alias("blocked"))
    whole = whole.select(F.col("run_id").alias("_run"), F.flatten(F.transform("links", lambda x: x["why"])).alias("of_datasets"), "blocked")
    out = out.join(whole, F.col("run_id") == F.col("_run"), "left")
    provenance = F.array_compact(F.array(F.when(~F.col("git_available"), "git is not available"), F.when(F.col("git_available") & F.col("git_dirty"), "uncommitted changes")))
    return out.withColumns({
        "license_blockers": F.concat(detector, F.coalesce("of_datasets", none)),
        "production_ready": F.coalesce(F.col("d_production_ready"), F.lit(False)) & ~F.coalesce("blocked", F.lit(False)),
        "provenance_blockers": provenance,
    }).drop("_run", "of_datasets", "blocked").withColumn("reproducible", F.size("provenance_blockers") == 0)


def cell(value: Column, half: Column) -> Column:
    """`v [lo,hi]`, or `v no CI` without an interval."""
    return F.when(value.isNull(), "-").when(half.isNull(), F.concat(fixed(value, 3), F.lit(" no CI"))).otherwise(F.concat(fixed(value, 3), F.lit(" ["), fixed(value - half, 3), F.lit(","), fixed(value + half, 3), F.lit("]")))


def scene_cell(n: Column, p95: Column, threshold: Column) -> Column:
    """`p95/threshold` of a scene, with a mark where p95 is over it; `-` for a scene without images."""
    shown = F.concat(fixed(p95, 3), F.lit("/"), fixed(threshold, 2), F.when(p95 > threshold, " !").otherwise(""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "-").otherwise(shown)


def dataset_violations(components: DataFrame) -> DataFrame:
    """component_id, violation: no sources, or ready in spite of a copyleft source."""
    v = F.when(F.size("sources") == 0, "no sources").when(F.col("production_ready") & F.exists("sources", copyleft), "ready with a copyleft source")
    return components.select("component_id", v.alias("violation")).where("violation is not null")


#: What a dataset is registered with; a run's provenance is all of it but production_ready and notes.
DATASET_SCHEMA = "name string, root string, license string, production_ready boolean, sources array<string>, origin string, version string, exported string, notes array<string>"
PROVENANCE = ("name", "origin", "version", "exported", "license", "sources")


def register_datasets(known: DataFrame, more: DataFrame) -> DataFrame:
    """The registry with more datasets. A name that occurs twice is an error."""
    out = known.unionByName(more)
    if twice := out.groupBy("name").count().where("count > 1").orderBy("name").limit(10).collect():
        raise ValueError(f"datasets registered twice: {[r['name'] for r in twice]}")
    return out


def provenance(runs: DataFrame, registry: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Adds to each run the struct `provenance` of its dataset. A dataset that isn't registered is an error of the query that
    reads it."""
    side = registry.select(F.col("name").alias("_name"), F.struct(*PROVENANCE).alias("_found"))
    unknown = F.raise_error(F.concat(F.lit("unknown dataset "), F.coalesce(F.col(dataset), F.lit("null"))))
    joined = runs.join(side, F.col(dataset) == F.col("_name"), "left")
    return joined.withColumn("provenance", F.when(F.col("_name").isNotNull(), F.col("_found")).otherwise(unknown)).drop("_name", "_found")
