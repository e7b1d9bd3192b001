"""Plans that find a value once: label lines, box formats and annotation quads."""

import pytest
from pyspark.sql import functions as F

from quadlake.functions import formats
from quadlake.plans import catalog
from quadlake.sources import labels

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["label_problems", "read_obb_lines", "convert_formats"])
def test_annotations_are_shuffled_once(spark, name):
    assert catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_line_is_judged_once(spark):
    df = spark.createDataFrame([("a", "0 .1 .1 .2 .1 .2 .2 .1 .2")], "path string, content string")
    out = labels.parse_lines(df).where("problem is not null").select("path", "problem")
    assert plan(out).count("degenerate") == 1


@pytest.mark.parametrize(
    "line, problem",
    [
        ("0 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2", None), ("0 .1 1e-1 +0.2 0.1 0.2 0.2 0.1 0.2", None), ("0\t0.1 0.1 0.2 0.1  0.2 0.2 0.1 0.2 ", None), ("-0 0.1 -0.1 0.2 -0.1 0.2 0.2 0.1 0.2", None),
        ("0 0.1 0.1 0.2 0.1 0.2 0.2 0.1", "tokens"), ("0 0.1 0.1 0.2 0.1 0.2 0.2 0.1 -", "number"), ("0 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2.0", "number"), ("0 NaN 0.1 0.2 0.1 0.2 0.2 0.1 0.2", "number"),
        ("0 0.123456789012345678 0.1 0.2 0.1 0.2 0.2 0.1 0.2", "digits"), ("0 0.00000000000000000001 0.1 0.2 0.1 0.2 0.2 0.1 0.2", None), ("1.5 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2", "class"), ("-1 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2", "class"),
        ("0 1.7 0.1 0.2 0.1 0.2 0.2 0.1 0.2", "range"), ("0 1e999 0.1 0.2 0.1 0.2 0.2 0.1 0.2", "range"), ("0 0.1 0.1 0.1 0.1 0.2 0.2 0.1 0.2", "degenerate"),
    ],
)
def test_lines_plain_and_not(spark, line, problem):
    got = labels.parse_lines(spark.createDataFrame([("a", line)], "path string, content string")).collect()
    assert [r.problem for r in got] == [problem]


def test_pixels_are_found_once(spark):
    df = spark.createDataFrame([([0.1, 0.1, 0.2, 0.1, 0.2, 0.2, 0.1, 0.2], 100, 50)], "q array<double>, w int, h int")
    out = df.select(formats.convert(F.col("q"), "obb_yolo", "dota", F.col("w"), F.col("h")).alias("v"))
    assert out.collect()[0].v == pytest.approx([10, 5, 20, 5, 20, 10, 10, 10])
    assert plan(out).count("cast(w") <= 1
