"""What a job leaves behind: split and fold tables with a manifest, run records, the log of test accesses, comparison tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import COCO_THRESHOLDS, PARAMS
from .exports import write_tree


#: Rows of a part of a digest.
_PART_ROWS = 50_000


def stamp(now: datetime | None = None) -> str:
    """A UTC time as in 20260102T030405Z."""
    return (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_json(spark: SparkSession, root: str, name: str, value: dict) -> None:
    write_tree(spark.createDataFrame([(name, json.dumps(value, sort_keys=True))], "relative_path string, content string"), root)


def assignment_digest(assigned: DataFrame, key: str = "split") -> str:
    """SHA-256 that names an assignment whatever the order of its rows. Rows are hashed in parts by the first digits of the MD5 of
    their id, each part sorted by itself; a digest over up to 4096 digests of parts, in order, names what they have in common, and
    so on to the top. The number of parts follows that of the rows, so no task and not the driver needs many ids."""
    digits, n = 3, assigned.count()
    while 16**digits * _PART_ROWS < n:
        digits += 3
    row = F.to_json(F.struct("id", F.col(key).alias("to")))
    part = F.substring(F.md5(F.col("id").cast("string")), 1, digits)
    parts = assigned.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("sha"))
    for shorter in range(digits - 3, -1, -3):
        below = F.array_join(F.array_sort(F.collect_list(F.concat("part", "sha"))), "\n")
        parts = parts.groupBy(F.substring("part", 1, shorter).alias("up")).agg(F.sha2(below, 256).alias("sha")).withColumnRenamed("up", "part")
    found = parts.first()
    return found["sha"] if found else hashlib.sha256(b"").hexdigest()


def write_assignment(assigned: DataFrame, root: str, *, key: str = "split", **notes) -> dict:
    """Writes id by split (or fold) below root, sorted by id, and manifest.json with counts and digest. An assignment is frozen:
    an existing root is an error."""
    spark = assigned.sparkSession
    if exists(spark, root):
        raise FileExistsError(root)
    assigned.select("id", key).repartition(key, F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions(key, "id").write.partitionBy(key).parquet(f"{root}/assignment")
    counts = {str(r[key]): r["n"] for r in assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"counts": counts, "digest": assignment_digest(assigned, key), "written": stamp(), **notes}
    write_json(spark, root, "manifest.json", manifest)
    return manifest


def read_assignment(spark: SparkSession, root: str, key: str = "split") -> DataFrame:
    """The rows of an assignment; an error if they aren't those of its manifest any more."""
    assigned = spark.read.parquet(f"{root}/assignment").select("id", F.col(key))
    manifest = json.loads(spark.read.text(f"{root}/manifest.json", wholetext=True).first()[0])
    if assignment_digest(assigned, key) != manifest["digest"]:
        raise ValueError(f"{root}: the assignment isn't that of its manifest")
    return assigned


def pool(assigned: DataFrame) -> DataFrame:
    """The samples that folds are made of: train and valid."""
    return assigned.where(F.col("split").isin("train", "valid"))


def match_thresholds() -> list[float]:
    """The matching threshold and the COCO ones, each once."""
    return sorted({PARAMS.match_iou, *COCO_THRESHOLDS})


def class_ids(rows: DataFrame, classes: DataFrame | dict[int, str], name: str = "class_name") -> DataFrame:
    """Adds class_id for a class name; an unknown name is an error of the query that reads it. classes: class_id, class_name (unique),
    as a table or a dict; Spark broadcasts it if it is small."""
    if isinstance(classes, dict):
        classes = rows.sparkSession.createDataFrame(list(classes.items()), "class_id int, class_name string")
    known = classes.select("class_id", F.col("class_name").alias("_name"))
    out = rows.join(known, F.col(name) == F.col("_name"), "left").drop("_name")
    unknown = F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(name), F.lit("null")))).cast(known.schema["class_id"].dataType)
    return out.withColumn("class_id", F.coalesce("class_id", unknown))


def padding_caveat(trained_padded: Column, infers_padded: Column) -> Column:
    """Text for a run that was trained on padded images and infers on others; null otherwise."""
    return F.when(trained_padded & ~infers_padded, F.lit("trained on padded images, inference without padding"))


def start_run(spark: SparkSession, root: str, name: str, config: dict) -> str:
    """Freezes a run's config before it begins. A run that exists is an error."""
    path = f"{root}/{name}"
    if exists(spark, path):
        raise FileExistsError(path)
    write_json(spark, path, "config.json", config)
    return path


def finish_run(spark: SparkSession, path: str, record: dict, metrics: dict) -> None:
    """Writes run.json and metrics.json of a run that has been started."""
    if not exists(spark, f"{path}/config.json"):
        raise FileNotFoundError(f"{path}/config.json")
    write_json(spark, path, "metrics.json", metrics)
    write_json(spark, path, "run.json", {"timestamp": stamp(), **record})


def _created(spark: SparkSession, system, folder, name: str, content: bytes) -> bool:
    """Writes a new file; False if it exists. Hadoop's local file system looks first and then creates, so there the operating
    system's exclusive open decides."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    if system.getUri().getScheme() == "file":
        try:
            with open(path.toUri().getPath(), "xb") as f:
                f.write(content)
        except FileExistsError:
            return False
        return True
    try:
        out = system.create(path, False)
    except Py4JJavaError:
        if system.exists(path):
            return False
        raise
    out.write(content)
    out.close()
    return True


def record_test_access(spark: SparkSession, log: str, run: str, reason: str) -> int:
    """Appends an access to the sealed test split, one JSON line in a file of its own, and gives its number.

    The file is named by the number and created only if it isn't there; who loses a race takes the next number, so accesses at
    the same time have different numbers and none overwrites another."""
    if not reason.strip():
        raise ValueError("an access to the test split needs a reason")
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    taken = [int(m[1]) for f in system.listStatus(folder) if (m := re.fullmatch(r"access-(\d+)\.json", f.getPath().getName()))]
    number = max(taken, default=0) + 1
    while True:
        line = json.dumps({"utc": stamp(), "run": run, "reason": reason, "access_number": number}) + "\n"
        if _created(spark, system, folder, f"access-{number:09d}.json", line.encode()):
            return number
        number += 1


def evaluate_on_test(spark: SparkSession, log: str, run: str, reason: str, evaluate: Callable[[], DataFrame]) -> tuple[int, DataFrame]:
    """Logs the access first, then evaluates: an evaluation that fails has been an access too."""
    number = record_test_access(spark, log, run, reason)
    return number, evaluate()


def stamp_text(ts: Column) -> Column:
    """The stamp of a UTC time in a column."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def write_runs(runs: DataFrame, root: str) -> None:
    """run.json of each run, and metrics.json where `metrics` (a struct) isn't null, below root; a run's folder is its column
    `name`. Many runs at once, by tasks; start_run and finish_run are for one."""
    path = lambda f: F.concat("name", F.lit(f"/{f}")).alias("relative_path")
    record = F.to_json(F.struct(*[c for c in runs.columns if c != "metrics"])).alias("content")
    write_tree(runs.select(path("run.json"), record).unionByName(runs.where("metrics is not null").select(path("metrics.json"), F.to_json("metrics").alias("content"))), root)


def write_comparison(runs: DataFrame, columns: list[str], path: str) -> None:
    """A CSV table of runs with a header and its columns in the given order."""
    runs.select(*columns).write.option("header", True).csv(path)
