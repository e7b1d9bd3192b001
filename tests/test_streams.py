"""Streams: in whatever batches samples arrive, splits are the same, and a batch that runs again changes nothing."""

from pyspark.sql import functions as F

from quadlake.streaming import batches


def run(spark, rows, frozen, root, files):
    df = spark.createDataFrame(rows, "id long, grp string")
    for k in range(files):
        df.where(F.col("id") % files == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    batches.extend_splits(stream, frozen, f"{root}/out", f"{root}/check").awaitTermination()
    return stream


def got(spark, root):
    return sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").select("id", "grp", "split").collect())


def test_batches_equal_one_run_and_replays_change_nothing(spark, tmp_path):
    frozen = spark.createDataFrame([(1000 + k, f"g{k}", ["train", "valid", "test"][k % 3]) for k in range(6)] + [(3, "g3", "train")], "id long, grp string, split string")
    rows = [(k, f"g{k % 40}") for k in range(200)] + [(7, "g7"), (1001, "g1")]
    run(spark, rows, frozen, f"{tmp_path}/one", 1)
    stream = run(spark, rows, frozen, f"{tmp_path}/three", 3)
    want = got(spark, f"{tmp_path}/one")
    assert got(spark, f"{tmp_path}/three") == want and len(want) == 199 and len({w[0] for w in want}) == 199
    assert len({(g, s) for _, g, s in want}) == 40  # a group is in one split
    assert next(s for i, _, s in want if i == 44) == "valid" and next(s for i, _, s in want if i == 41) == "valid"
    # nothing new has arrived: no batch; without its checkpoint the stream runs all batches again over the same folders
    batches.extend_splits(stream, frozen, f"{tmp_path}/three/out", f"{tmp_path}/three/check").awaitTermination()
    batches.extend_splits(stream, frozen, f"{tmp_path}/three/out", f"{tmp_path}/three/again").awaitTermination()
    assert got(spark, f"{tmp_path}/three") == want


def test_accesses_are_followed(spark, tmp_path):
    from quadlake.operators.records import record_test_access

    log, root = f"file://{tmp_path}/log", f"{tmp_path}/kept"
    for k in range(3):
        record_test_access(spark, log, f"r{k}", "why")
    follow = lambda: batches.follow_accesses(spark.readStream.text(log), root, f"{tmp_path}/check").awaitTermination()
    follow()
    record_test_access(spark, log, "r3", "again")
    (tmp_path / "log" / "broken.json").write_text("{no\n")
    follow()
    assert sorted((r.run, r.readable) for r in spark.read.parquet(root).collect()) == [("?", False), *((f"r{k}", True) for k in range(4))]
