"""Hand values for single operators, and the sources and sinks that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from quadlake.functions import geometry as g
from quadlake.operators import governance, exports, splits
from quadlake.operators.overlap import covered_by_others, rotated_iou, union_area
from quadlake.params import Params
from quadlake.sources import labels


def quads(spark, rows):
    """(image_id, idx, x, y, w, h) boxes along the axes."""
    df = spark.createDataFrame(rows, "image_id long, idx int, x double, y double, w double, h double")
    x, y, w, h = (F.col(c) for c in "xywh")
    return df.select("image_id", "idx", g.quad([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]).alias("q"))


def test_union_not_pairwise(spark):
    """Two strips that cover 40 % each, without overlap, leave 20 % visible; twice the same strip leaves 60 %."""
    q = quads(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 4.0, 10.0), (1, 2, 6.0, 0.0, 4.0, 10.0), (2, 0, 0.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 4.0, 10.0), (2, 2, 0.0, 0.0, 4.0, 10.0), (3, 0, 0.0, 0.0, 5.0, 5.0)])
    got = {(r.image_id, r.idx): r.covered / r.area for r in covered_by_others(q, ["image_id"]).collect()}
    assert got[1, 0] == pytest.approx(0.8) and got[2, 0] == pytest.approx(0.4) and got[2, 1] == pytest.approx(1) and got[3, 0] == 0
    area = {r.image_id: r.union_area for r in union_area(q, ["image_id"]).collect()}
    assert area == pytest.approx({1: 100, 2: 100, 3: 25})


def test_iou_of_half_overlap(spark):
    q = quads(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 5.0, 0.0, 10.0, 10.0), (1, 2, 10.0, 0.0, 3.0, 10.0)])
    out = rotated_iou(q.withColumnsRenamed({"idx": "a_idx", "q": "qa"}), q.withColumnsRenamed({"idx": "b_idx", "q": "qb"}), ["image_id"], F.col("a_idx") < F.col("b_idx"))
    got = {(r.a_idx, r.b_idx): r.iou for r in out.collect()}
    assert got == pytest.approx({(0, 1): 1 / 3, (1, 2): 3 / 10})


def test_canonical_order_ignores_input_order(spark):
    pts = [(0.1, 0.1), (0.5, 0.2), (0.45, 0.4), (0.05, 0.3)]
    rows = [([dict(x=x, y=y) for x, y in pts[i:] + pts[:i]],) for i in range(4)] + [([dict(x=x, y=y) for x, y in reversed(pts)],)]
    df = spark.createDataFrame(rows, "q array<struct<x:double,y:double>>")
    got = {str(r.c) for r in df.select(g.canonical(F.col("q"), F.lit(1.0)).alias("c")).collect()}
    assert len(got) == 1


def test_folds_are_those_of_one_by_one():
    import random

    rng = random.Random(1)
    for _ in range(200):
        k, sizes = rng.randrange(2, 7), sorted((rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))), reverse=True)
        load, want = [0] * k, []
        for s in sizes:
            i = min(range(k), key=lambda f: (load[f], f))
            want.append(i)
            load[i] += s
        hist = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        got = []
        for runs in splits.level_folds(hist, k):
            for fold, n in runs:
                got += list(fold) * n if isinstance(fold, tuple) else [fold] * n
        assert got == want


def test_sealed_split_and_options(spark):
    df = spark.createDataFrame([("a", "test")], "id string, split string")
    with pytest.raises(PermissionError):
        splits.load_split(df, "test")
    assert splits.load_split(df, "test", allow_test=True).count() == 1
    with pytest.raises(ValueError):
        Params(ratios=(0.5, 0.5, 0.5))


def test_label_tree_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train/labels/a.txt", "0 0.1 0.1 0.5 0.1 0.5 0.3 0.1 0.3\n\n"), ("train/labels/b.txt", ""), ("train/images/a.jpg", "x"), ("val/images/c.png", "x"), ("val/labels/c.txt", "0 0.1 0.1 0.5\nx 1 2 3 4 5 6 7 8")], "relative_path string, content string")
    exports.write_tree(rows, f"file://{tmp_path}")
    files = labels.list_files(spark, str(tmp_path))
    assert labels.detect_layout(files) == ("adopt", ["val is read as valid", "no test split"])
    lost = labels.orphans(files.where("kind = 'images'"), files.where("kind = 'labels'"), "stem").collect()
    assert [(r.stem, r.missing) for r in lost] == [("b", "left")]
    parsed = labels.parse_lines(labels.read_label_files(spark, str(tmp_path)))
    assert sorted((r.problem or "") for r in parsed.collect()) == ["", "number", "tokens"]
    with pytest.raises(ValueError, match="tokens"):
        labels.strict(parsed)


def test_flat_folders(spark, tmp_path):
    def tree(name, *files):
        for f in files:
            at = tmp_path / name / f
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text("")
        return str(tmp_path / name)

    got = labels.flat_samples(spark, tree("pair", "images/a.JPG", "images/b.png", "labels/a.txt", "labels/b.txt", "readme.txt")).collect()
    assert {(r.sample_id, r.image_path[-12:], r.label_path[-12:]) for r in got} == {("a", "images/a.JPG", "labels/a.txt"), ("b", "images/b.png", "labels/b.txt")}
    got = labels.flat_samples(spark, tree("beside", "a.jpg", "a.txt", "deep/er/c.webp", "deep/er/c.txt", "deep/notes.txt")).collect()
    assert sorted(r.sample_id for r in got) == ["a", "c"] and all(r.image_path.rsplit(".", 1)[0] == r.label_path[:-4] for r in got)
    bad = [("none", ["x/a.txt"], "no image"), ("twice", ["a.jpg", "a.txt", "x/a.png", "x/a.txt"], "more than once"), ("far", ["a.jpg", "x/a.txt"], "without labels"), ("lone", ["images/a.jpg", "labels/a.txt", "labels/b.txt"], "without image")]
    for name, files, message in bad:
        with pytest.raises(ValueError, match=message):
            labels.flat_samples(spark, tree(name, *files))


def test_dataset_registry(spark):
    row = lambda n: (n, f"/data/{n}", "MIT", True, ["MIT"], "https://example.org", "v1", "2026-01-02", ["a note"])
    table = lambda *names: spark.createDataFrame([row(n) for n in names], governance.DATASET_SCHEMA)
    registry = governance.register_datasets(table("a"), table("b"))
    run = lambda d: spark.createDataFrame([("r", d)], "run string, dataset string")
    got = governance.provenance(run("b"), registry).first()
    assert got.provenance.asDict() == {"name": "b", "origin": "https://example.org", "version": "v1", "exported": "2026-01-02", "license": "MIT", "sources": ["MIT"]}
    with pytest.raises(ValueError, match="twice"):
        governance.register_datasets(registry, table("a"))
    for d in ("c", None):
        with pytest.raises(Exception, match="unknown dataset"):
            governance.provenance(run(d), registry).collect()


def test_test_accesses_count_unreadable_lines(spark):
    df = spark.createDataFrame([('{"utc": "u", "run": "r", "reason": "why"}',), ("{broken",), (" ",)], "value string")
    assert [tuple(r) for r in labels.read_test_accesses(df).collect()] == [("u", "r", "why", True), ("?", "?", "[unreadable line]", False)]


def test_every_order_is_an_image(spark, tmp_path):
    from quadlake.fixtures import fx

    rows = [(k, 10 + k, 3 * k + n, n, 5.0 * n, 100.0 * k, "2020-01-01") for k in range(1, 41) for n in (1, 2)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.image_id for r in fx(spark, str(tmp_path), "fx_images").collect()) == list(range(1, 41))
    boxes = fx(spark, str(tmp_path), "fx_box").collect()
    assert sorted((r.image_id, r.ann_idx) for r in boxes) == [(k, n) for k in range(1, 41) for n in (0, 1)]
    shifted = {r.image_id for r in boxes if float(r.cx) / (640 + 32 * (r.image_id % 11)) - 0.35 - 0.0003 * (((10 + r.image_id) * 37 + r.ann_idx * 211) % 1000) > 0.2}
    assert shifted == {7, 14, 21, 28, 35}
    truths = fx(spark, str(tmp_path), "fx_truth").select("image_id").distinct().count()
    assert truths == fx(spark, str(tmp_path), "fx_cells").select("image_id").distinct().count() == 40


def test_assignments_are_frozen_and_read_back(spark, tmp_path):
    from quadlake.operators import records

    rows = [(f"i{k:03d}", ["train", "valid", "test"][k % 3]) for k in range(60)]
    assigned, root = spark.createDataFrame(rows, "id string, split string"), f"file://{tmp_path}/splits"
    manifest = records.write_assignment(assigned, root, mode="create")
    assert manifest["counts"] == {"train": 20, "valid": 20, "test": 20} and manifest["mode"] == "create"
    assert sorted(map(tuple, records.read_assignment(spark, root).collect())) == rows
    assert manifest["digest"] == records.assignment_digest(assigned.repartition(5)) != records.assignment_digest(assigned.where("id <> 'i000'"))
    with pytest.raises(FileExistsError):
        records.write_assignment(assigned, root)
    assert records.pool(assigned).count() == 40


def test_runs_and_test_accesses_are_recorded(spark, tmp_path):
    from quadlake.operators import records

    root = f"file://{tmp_path}/runs"
    path = records.start_run(spark, root, "a", {"epochs": 1})
    with pytest.raises(FileExistsError):
        records.start_run(spark, root, "a", {})
    records.finish_run(spark, path, {"name": "a", "production_ready": True}, {"map50": 0.5})
    got = labels.discover_runs(spark, root).collect()
    assert [(r.run, r.name, r.production_ready, r.metrics) for r in got] == [("a", "a", True, '{"map50": 0.5}')]
    log = f"file://{tmp_path}/log"
    assert [records.record_test_access(spark, log, "a", "why"), records.evaluate_on_test(spark, log, "a", "again", lambda: got)[0]] == [1, 2]
    assert sorted(r.reason for r in labels.read_test_accesses(spark.read.text(log)).collect()) == ["again", "why"]
    with pytest.raises(ValueError):
        records.record_test_access(spark, log, "a", " ")
    records.write_comparison(spark.createDataFrame([("a", 0.5)], "run string, map50 double"), ["map50", "run"], f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["map50", "run"]


def test_coco_document_is_one_json(spark, tmp_path):
    import json

    quad = "array(named_struct('x', 0.1D, 'y', 0.1D), named_struct('x', 0.5D, 'y', 0.1D), named_struct('x', 0.5D, 'y', 0.3D), named_struct('x', 0.1D, 'y', 0.3D))"
    prepared = spark.sql(f"SELECT image_id, CAST(ann_idx AS INT) AS ann_idx, 0 AS class_id, 100 AS out_width, 50 AS out_height, {quad} AS quad_out FROM VALUES (7L, 0), (7L, 1), (5000L, 0) t(image_id, ann_idx)")
    exports.coco_document(prepared, {0: "note"}).write.text(f"{tmp_path}/coco")
    text = "".join(p.read_text() for p in sorted((tmp_path / "coco").glob("part-*")))
    doc = json.loads(text)
    assert [i["id"] for i in doc["images"]] == [1, 2] and [a["id"] for a in doc["annotations"]] == [1, 2, 3]
    assert [a["image_id"] for a in doc["annotations"]] == [1, 1, 2] and doc["annotations"][0]["bbox"] == [10.0, 5.0, 40.0, 10.0]
    assert doc["categories"] == [{"id": 1, "name": "note"}]
    files = exports.EXPORTERS["coco"](prepared).collect()
    assert sorted(len(json.loads(r.content)) for r in files) == [1, 2]


def test_unknown_classes_are_errors(spark):
    from quadlake.operators import records

    rows = spark.createDataFrame([("note",), ("coin",)], "class_name string")
    assert [r.class_id for r in records.class_ids(rows, {0: "note", 1: "coin"}).collect()] == [0, 1]
    with pytest.raises(Exception, match="unknown class coin"):
        records.class_ids(rows, {0: "note"}).collect()
    assert records.match_thresholds()[0] == 0.5 and len(records.match_thresholds()) == 10


def test_formats_go_through_the_quad(spark):
    from quadlake.functions.formats import convert

    size = (F.lit(200), F.lit(100))
    df = spark.createDataFrame([([0.1, 0.2, 0.5, 0.2, 0.5, 0.6, 0.1, 0.6],)], "v array<double>")
    one = lambda c: df.select(c).first()[0]
    assert one(convert(F.col("v"), "obb_yolo", "coco", *size)) == pytest.approx([20, 20, 80, 40])
    assert one(convert(F.col("v"), "obb_yolo", "bbox_yolo")) == pytest.approx([0.3, 0.4, 0.4, 0.4])
    voc = convert(F.col("v"), "obb_yolo", "voc_xml", *size)
    assert one(voc) == pytest.approx([60, 40, 80, 40, 0])
    assert one(convert(voc, "voc_xml", "obb_yolo", *size)) == pytest.approx([0.1, 0.2, 0.5, 0.2, 0.5, 0.6, 0.1, 0.6])
    with pytest.raises(ValueError, match="size"):
        convert(F.col("v"), "obb_yolo", "dota")
    with pytest.raises(ValueError, match="unknown"):
        convert(F.col("v"), "obb_yolo", "x")


def test_canonical_order_gives_indices_and_margin(spark):
    pts = [(0.5, 0.6), (0.1, 0.6), (0.1, 0.2), (0.5, 0.2)]
    df = spark.createDataFrame([([dict(x=x, y=y) for x, y in pts],)], "q array<struct<x:double,y:double>>")
    got = df.select(g.canonical_order(F.col("q"), F.lit(1.0)).alias("o"), g.is_canonical(F.col("q"), F.lit(1.0)).alias("same")).first()
    assert got.o.order == [2, 3, 0, 1] and got.o.margin == pytest.approx(0.4) and not got.same
    flat = spark.createDataFrame([([dict(x=x, y=0.5) for x in (0.1, 0.2, 0.3, 0.4)],)], "q array<struct<x:double,y:double>>")
    with pytest.raises(Exception, match="polar"):
        flat.select(g.canonical_order(F.col("q"), F.lit(1.0))).collect()


def test_documents_are_json(spark, tmp_path):
    import json

    from quadlake.operators import reports

    groups = spark.createDataFrame([("b", 'x"y'), ("a", "x"), ("c", None)], "id string, grp string")
    lines = [r.line for r in reports.group_manifest(groups).collect()]
    assert json.loads("".join(lines)) == {"a": "x", "b": 'x"y', "c": None} and lines[1].startswith('"a"')
    assert json.loads("".join(r.line for r in reports.group_manifest(groups.where("false")).collect())) == {}
    assert reports.data_yaml("/d", {0: "note"}).splitlines() == ['path: "/d"', "train: train/images", "val: valid/images", "names:", '  0: "note"']
    reports.write_image_sets(spark.createDataFrame([("i1", "valid"), ("i2", "train")], "id string, split string"), f"file://{tmp_path}/sets")
    assert {r.value for r in spark.read.text(f"file://{tmp_path}/sets").collect()} == {"i1", "i2"}


def test_exports_are_refused_before_anything_is_written(spark, tmp_path):
    from quadlake.operators import annotations as an

    boxes = spark.createDataFrame([(1, 0, 0, 60.0, 40.0, 80.0, 40.0, 0.3)], "image_id long, ann_idx int, class_id int, cx double, cy double, w double, h double, theta double")
    rows = an.area_filter(an.annotate(boxes, spark.createDataFrame([(1, 200, 100)], "image_id long, width int, height int")))
    root = f"file://{tmp_path}/out"
    exports.export_tree(rows, "voc_xml", root, "keep", {0: "note"})
    assert labels.read_voc(spark, f"{root}/Annotations").first().category == "note"
    with pytest.raises(ValueError, match="clip"):
        exports.export_tree(rows, "voc_xml", root, "clip", {0: "note"})
    assert (tmp_path / "out" / "Annotations" / "1.xml").exists()
    exports.export_tree(rows, "bbox_yolo", root, "clip", {0: "note"})
    assert not (tmp_path / "out" / "Annotations").exists() and labels.read_bbox_yolo(labels.read_label_files(spark, root)).count() == 1


def test_fixed_prints_as_c_does(spark):
    import random

    from quadlake.functions.text import fixed

    rng = random.Random(1)
    values = [552.7265625, 552.7265635, 0.0078125, 1.5, -2.0000005, -552.7265625, 0.5, 1e-9, 123456.0, 0.0, -0.0, 3.0000015, 1.0000025]
    values += [rng.randrange(2**40) / 2**30 for _ in range(300)] + [rng.randrange(10**9) / 10**7 for _ in range(3000)] + [(rng.randrange(2**20) + 0.5) / 2**7 for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(fixed(F.col("v"), 6)).collect()]
    assert [(v, x) for v, x in zip(values, got, strict=True) if x != f"{v:.6f}"] == []
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(fixed(F.col("v"), 3)).collect()]
    assert [(v, x) for v, x in zip(values, got, strict=True) if x != f"{v:.3f}"] == []
