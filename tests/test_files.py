"""Trees and documents written and read back: listings, header sizes, DOTA, COCO, split files and manifests."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from quadlake.operators import exports, records
from quadlake.sources import files, labels


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x06\0\0\0"


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 300) + bytes(298) + b"\xff\xff\xc4" + struct.pack(">H", 20) + bytes(18) + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + bytes(30)


def tiff(w, h, order="<"):
    entries = [(255, 3, 1, 0), (256, 3, 1, w), (257, 4, 1, h)]
    body = b"".join(struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, n, v in entries)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 3) + body


def webp(form, w, h):
    body = {b"VP8X": bytes(8) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"), b"VP8L": bytes(4) + b"\x2f" + struct.pack("<I", w - 1 | h - 1 << 14), b"VP8 ": bytes(4) + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", w, h)}[form]
    return b"RIFF" + bytes(4) + b"WEBP" + form + body


IMAGES = {"a.png": (png(640, 480), 640, 480), "b.jpg": (jpeg(70, 5000), 70, 5000), "c.JPEG": (jpeg(1, 2), 1, 2), "d.bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 33, -44), 33, 44), "e.tif": (tiff(11, 70000), 11, 70000), "f.tiff": (tiff(12, 13, ">"), 12, 13), "g.webp": (webp(b"VP8X", 16000, 3), 16000, 3), "h.webp": (webp(b"VP8L", 17, 16384), 17, 16384), "i.webp": (webp(b"VP8 ", 18, 19), 18, 19)}


def test_sizes_from_headers(spark, tmp_path, monkeypatch):
    for name, (data, _, _) in IMAGES.items():
        at = tmp_path / "x" / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(data)
    for name, data in (("bad.png", b"no image"), ("cut.jpg", jpeg(5, 5)[:320]), ("empty.bmp", b""), ("note.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert {n: (r.width, r.height) for n, r in got.items() if r.problem is None} == {n: x[1:] for n, x in IMAGES.items()}
    assert {n for n, r in got.items() if r.problem} == {"bad.png", "cut.jpg", "empty.bmp"}
    # the cache has sizes that no file has: had a file been opened, its own would come
    cached = spark.createDataFrame([(str(tmp_path / "x" / n), -1, -2) for n in list(IMAGES)[:4]] + [("/gone.png", 8, 9)], "path string, width int, height int")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in files.image_sizes(spark, str(tmp_path), cached).where("problem is null").collect()}
    assert got == {n: (-1, -2) if k < 4 else x[1:] for k, (n, x) in enumerate(IMAGES.items())} | {"gone.png": (8, 9)}


def test_listing_by_rounds(spark, tmp_path):
    want = set()
    for k in range(40):
        at = tmp_path.joinpath(*[f"d{(k >> b) & 1}" for b in range(k % 6)], f"f{k}.txt")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * k)
        want.add((str(at), k))
    (tmp_path / "no" / "files").mkdir(parents=True)
    assert {tuple(r) for r in files.all_files(spark, str(tmp_path)).collect()} == want
    assert files.all_files(spark, f"file://{tmp_path}/no").count() == 0


def test_coco_line_by_line_and_whole(spark, tmp_path):
    images = [{"id": k, "file_name": f"{k}.jpg", "width": 100, "height": 50} for k in range(1, 6)]
    notes = [{"id": k, "image_id": k % 5 + 1, "category_id": 1, "bbox": [k, 2, 30, 20.5], "area": 1.0, "iscrowd": 0} for k in range(1, 9)]
    doc = {"images": images, "categories": [{"id": 1, "name": "x"}], "annotations": notes}
    comma = lambda rows: "\n".join(("," if k else "") + json.dumps(r) for k, r in enumerate(rows))
    texts = {"lines": f'{{"images":[\n{comma(images)}\n],"categories":[{{"id": 1, "name": "x"}}],"annotations":[\n{comma(notes)}\n]}}', "one": json.dumps(doc), "deep": json.dumps(doc, indent=2)}
    out = {}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        out[name] = sorted((r.file_name, r.category_id, [(p.x, p.y) for p in r.quad]) for r in labels.read_coco(spark, f"{tmp_path}/{name}.json").collect())
    assert len(out["lines"]) == 8 and out["lines"] == out["one"] == out["deep"]
    assert out["one"][0][2][2] == (pytest.approx(0.35), pytest.approx(0.45))


def test_group_manifests(spark, tmp_path):
    want = {"a": "g1", "b": "g{2},", "c d": "x", "é\"": "1"}
    for indent in (None, 2):
        (tmp_path / "m.json").write_text(json.dumps(want, indent=indent))
        assert {r.id: r.grp for r in labels.read_group_manifest(spark, f"{tmp_path}/m.json").collect()} == want
    for bad in ("[1, 2]", '"text"'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="not an object"):
            labels.read_group_manifest(spark, f"{tmp_path}/bad.json").collect()


def test_dota_and_split_files(spark, tmp_path):
    rows = spark.createDataFrame([("p", "imagesource:x\n10 20 30 20 30 40 10 40 note 0\n1 2 3\n5 5 9 5 9 9 5 9 note\r\n", 1)], "path string, content string, image_id int")
    images = spark.createDataFrame([(1, 100, 50)], "image_id int, width int, height int")
    got = labels.read_dota(rows, images).orderBy("line_no").collect()
    assert [(r.line_no, r.category, round(r.quad[2].x, 6), round(r.quad[2].y, 6)) for r in got] == [(2, "note", 0.3, 0.8), (4, "note", 0.09, 0.18)]
    (tmp_path / "train.txt").write_text("# frozen\n\n a \nb\n#c\n")
    assert [r.id for r in labels.read_split_file(spark, f"{tmp_path}/train.txt").collect()] == ["a", "b"]


def test_written_trees_are_listed(spark, tmp_path):
    rows = spark.createDataFrame([("i/1.png", bytearray(png(3, 4)))], "relative_path string, content binary")
    exports.write_tree(rows, f"file://{tmp_path}/t")
    assert [(r.width, r.height) for r in files.image_sizes(spark, f"file://{tmp_path}/t").collect()] == [(3, 4)]


def test_parallel_accesses_get_distinct_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = f"file://{tmp_path}/log"
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: records.record_test_access(spark, log, f"r{k}", "why"), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    lines = labels.read_test_accesses(spark.read.text(log)).select("run", F.col("readable")).collect()
    assert {r.run for r in lines} == {f"r{k}" for k in range(24)} and all(r.readable for r in lines)
