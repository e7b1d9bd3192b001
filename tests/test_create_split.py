"""A new split asks for what it must know before it reads anything."""

import pytest
from pyspark.sql import functions as F

from quadlake.operators import splits


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(60).select(F.concat(F.lit("s"), (F.col("id") % 12).cast("string"), F.lit("_"), F.col("id").cast("string")).alias("id"), (F.col("id") % 5).cast("string").alias("directory"))


def test_options_are_checked_first(samples):
    broken = samples.withColumn("id", F.raise_error(F.lit("was read")).cast("string"))
    for options, message in (({"strategy": "none"}, "independent"), ({"strategy": "prefix"}, "one capture"), ({"strategy": "prefix", "regex": "(a)(b)"}, "one capture"), ({"strategy": "manifest"}, "needs a manifest"), ({"strategy": "other"}, "unknown")):
        with pytest.raises(ValueError, match=message):
            splits.create_split(broken, **options)


@pytest.mark.parametrize("strategy", ["none", "prefix", "directory", "manifest"])
def test_groups_are_in_one_split(samples, strategy):
    manifest = samples.select("id", F.substring("id", -1, 1).alias("grp"))
    out = splits.create_split(samples, strategy, regex=r"^(s\d+)_", manifest=manifest, independence_confirmed=True)
    rows = out.collect()
    assert len(rows) == 60 and len({(r.grp, r.split) for r in rows}) == len({r.grp for r in rows}) == {"none": 60, "prefix": 12, "directory": 5, "manifest": 10}[strategy]


def test_a_sample_without_group_is_an_error(samples):
    with pytest.raises(Exception, match="not in the manifest"):
        splits.create_split(samples, "manifest", manifest=samples.limit(3).select("id", F.lit("g").alias("grp"))).collect()
