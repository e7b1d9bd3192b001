"""Queries on what jobs write and read back: manifests, run records, accesses to the test split, reports, and box formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import fx, table
from ..functions import formats
from ..functions import geometry as g
from ..functions.text import fixed
from ..operators import annotations as an
from ..operators import duplicates, exports, governance, images, records, reports, splits
from ..params import PARAMS
from ..scratch import shared_root, written
from ..sources import labels
from .boxes import FOUND, PQ, TQ, canonical_sql, filtered, findings, flat, pred_polygons, r, shapes, truth
from .registry import query
from .tables import _KNOWN, _LEAK, LIKE, _cut_sql, customers, embedding_pairs, embedding_splits, known_customers, prepared


def fresh_root(spark) -> str:
    return f"{shared_root(spark)}/out-{uuid.uuid4().hex}"


# ---- assignments ----
def _digest_sql(rows: str, key: str, quote: str) -> str:
    return f"""pt AS (SELECT left(md5(CAST(id AS VARCHAR)), 3) AS part, '{{"id":' || id || ',"to":{quote}' || {key} || '{quote}}}' AS j FROM {rows}),
 hs AS (SELECT part || sha256(string_agg(j, chr(10) ORDER BY j)) AS ph FROM pt GROUP BY part), dg AS (SELECT sha256(string_agg(ph, chr(10) ORDER BY ph)) AS digest FROM hs)"""


_SPLIT_ROWS = f"gs AS (SELECT DISTINCT c_nationkey AS grp FROM customer), {_cut_sql('gs', PARAMS.seed, 'ct')}, sp AS (SELECT c_custkey AS id, split FROM customer JOIN ct ON c_nationkey = grp)"


def _frozen(assigned: DataFrame, key: str) -> DataFrame:
    """Counts and digest of an assignment after it has been written and read back by its manifest."""
    spark, root = assigned.sparkSession, fresh_root(assigned.sparkSession)
    manifest = records.write_assignment(written(assigned), root, key=key)
    return records.read_assignment(spark, root, key).groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.lit(manifest["digest"]))


@query(f"WITH {_SPLIT_ROWS}, {_digest_sql('sp', 'split', chr(34))} SELECT split, count(*) AS n, any_value(digest) AS digest FROM sp, dg GROUP BY split")
def split_manifest(spark, sf):
    return _frozen(splits.random_split(customers(spark, sf)), "split")


@query(f"""WITH RECURSIVE s AS (SELECT c_nationkey AS grp, count(*) AS size FROM customer GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, grp) AS k FROM s),
 f AS (SELECT 0::BIGINT AS k, NULL::INT AS grp, NULL::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
   UNION ALL SELECT o.k, o.grp, list_position(load, list_min(load)) - 1, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + o.size ELSE x END) FROM f JOIN o ON o.k = f.k + 1),
 sp AS (SELECT c_custkey AS id, CAST(fold AS INT) AS fold FROM customer JOIN f ON c_nationkey = f.grp), {_digest_sql('sp', 'fold', '')} SELECT fold, count(*) AS n, any_value(digest) AS digest FROM sp, dg GROUP BY fold""")
def fold_manifest(spark, sf):
    return _frozen(splits.grouped_folds(customers(spark, sf)), "fold")


@query(f"WITH {_SPLIT_ROWS} SELECT id, split FROM sp WHERE split <> 'test'")
def fold_pool(spark, sf):
    return records.pool(splits.random_split(customers(spark, sf))).select("id", "split")


@query(f"WITH {_SPLIT_ROWS} SELECT 'ImageSets/Main/' || CASE split WHEN 'valid' THEN 'val' ELSE split END || '.txt' AS relative_path, CAST(id AS VARCHAR) AS line FROM sp")
def image_sets(spark, sf):
    return reports.image_sets(splits.random_split(customers(spark, sf)))


@query(f"""WITH {_KNOWN}, nw AS (SELECT c_custkey AS id, c_nationkey AS grp FROM customer WHERE c_custkey NOT IN (SELECT id FROM kn)), og AS (SELECT grp, min(split) AS split FROM kn GROUP BY grp),
 ad AS (SELECT id, grp, CASE WHEN id % 4 = 0 THEN 'train' ELSE 'valid' END AS split FROM nw WHERE grp NOT IN (SELECT grp FROM og) AND id % 2 = 0),
 nf AS (SELECT * FROM nw WHERE grp NOT IN (SELECT grp FROM og) AND id % 2 = 1), fr AS (SELECT DISTINCT grp FROM nf), {_cut_sql('fr', PARAMS.seed + 1, 'ct')}
 SELECT id, nw.grp, split, 'inherited' AS how FROM nw JOIN og ON nw.grp = og.grp UNION ALL SELECT id, grp, split, 'directory' FROM ad UNION ALL SELECT id, nf.grp, split, 'fresh' FROM nf JOIN ct ON nf.grp = ct.grp""")
def extend_adopted_splits(spark, sf):
    """As extend_splits; samples with an even id lie in a split's folder, which counts where their group has no split."""
    c = customers(spark, sf)
    return splits.extend_splits(c, known_customers(spark, sf), adopted=c.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "train").otherwise("valid").alias("split")))


@query(f"WITH {_SPLIT_ROWS}, n AS (SELECT count(*) AS samples FROM sp WHERE split = 'test') SELECT k + 1 AS access_number, 'run-' || k AS run, 'check ' || k AS reason, samples FROM n, range(2) x(k)")
def test_evaluations(spark, sf):
    """Two evaluations on the sealed test split, each logged before it runs."""
    log, assigned = fresh_root(spark), written(splits.random_split(customers(spark, sf)))
    for k in range(2):
        _, rows = records.evaluate_on_test(spark, log, f"run-{k}", f"check {k}", lambda: splits.load_split(assigned, "test", allow_test=True).agg(F.count(F.lit(1)).alias("samples")))
    entries = spark.read.schema("access_number long, run string, reason string").json(log)
    return entries.crossJoin(F.broadcast(rows))


# ---- runs ----
_NAME = "'run-' || lpad(CAST(run_id AS VARCHAR), 6, '0')"


@query(f"""SELECT {_NAME} AS run, strftime(TIMESTAMP '2026-01-01' + to_seconds(run_id), '%Y%m%dT%H%M%SZ') AS timestamp, CAST(detector_id AS VARCHAR) AS detector, NOT git_dirty AS reproducible,
 CASE WHEN ci_half IS NOT NULL THEN printf('%.4f', map50) END AS map50 FROM fx_runs""")
def run_records(spark, sf):
    """Run records written to a folder each, some without metrics, and discovered again."""
    runs, root = fx(spark, sf, "fx_runs"), fresh_root(spark)
    name = F.concat(F.lit("run-"), F.lpad(F.col("run_id").cast("string"), 6, "0"))
    at = records.stamp_text(F.timestamp_seconds(F.col("run_id") + 1767225600))
    metrics = F.when(F.col("ci_half").isNotNull(), F.struct(fixed(F.col("map50"), 4).alias("map50")))
    rows = runs.select(name.alias("name"), at.alias("timestamp"), F.struct(F.col("detector_id").cast("string").alias("name")).alias("detector"), (~F.col("git_dirty")).alias("reproducible"), metrics.alias("metrics"))
    records.write_runs(rows, root)
    return labels.discover_runs(spark, root).select("run", "timestamp", F.col("detector.name").alias("detector"), "reproducible", F.get_json_object("metrics", "$.map50").alias("map50"))


@query("SELECT map50, run_id, detector_id, git_dirty FROM (SELECT printf('%.3f', map50) AS map50, run_id, detector_id, git_dirty FROM fx_runs)")
def comparison_csv(spark, sf):
    """The comparison table, written as CSV in a fixed order of columns and read back."""
    path = fresh_root(spark)
    runs = fx(spark, sf, "fx_runs").withColumn("map50", fixed(F.col("map50"), 3))
    records.write_comparison(runs, ["run_id", "detector_id", "git_dirty", "map50"], path)
    return spark.read.option("header", True).schema("run_id long, detector_id long, git_dirty boolean, map50 string").csv(path)


@query("""SELECT run_id, CASE WHEN run_id % 4 = 0 THEN '-' ELSE printf('%.3f/%.2f', map50 / 10, 0.02 * (1 + run_id % 5)) || CASE WHEN map50 / 10 > 0.02::DOUBLE * (1 + run_id % 5) THEN ' !' ELSE '' END END AS cell,
 CASE WHEN run_id % 3 = 0 AND run_id % 2 = 1 THEN 'trained on padded images, inference without padding' END AS caveat FROM fx_runs""")
def scene_cells(spark, sf):
    """A scene's cell of the comparison and the caveat on padding, for each run."""
    k, p95 = F.col("run_id"), F.col("map50") / 10
    return fx(spark, sf, "fx_runs").select("run_id", governance.scene_cell(k % 4, p95, F.lit(0.02) * (1 + k % 5)).alias("cell"), records.padding_caveat(k % 3 == 0, k % 2 == 0).alias("caveat"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def run_stamp(spark, sf):
    return table(spark, sf, "events").select("event_id", records.stamp_text(F.col("ts")).alias("stamp"))


@query("SELECT n_nationkey, r_name AS class_name, n_regionkey AS class_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def class_lookup(spark, sf):
    """Class names to ids; the classes are those of region. An unknown name would be an error."""
    classes = table(spark, sf, "region").select(F.col("r_regionkey").alias("class_id"), F.col("r_name").alias("class_name"))
    named = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return records.class_ids(named.select("n_nationkey", F.col("r_name").alias("class_name")), classes)


# ---- reports ----
def _document_sql(opening: str, items: str, order: str, closing: str = "]}") -> str:
    """Lines of a document; items: a query that gives j."""
    return f"SELECT {opening} AS line UNION ALL SELECT CASE WHEN row_number() OVER (ORDER BY {order}) = 1 THEN j ELSE ',' || j END FROM ({items}) UNION ALL SELECT '{closing}'"


@query(_document_sql("'{'", "SELECT doc_id, '\"' || doc_id || '\": ' || CASE WHEN source IS NULL THEN 'null' ELSE '\"' || source || '\"' END AS j FROM documents", "CAST(doc_id AS VARCHAR)", "}"))
def group_manifest(spark, sf):
    return reports.group_manifest(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp")))


_HEAD = """(SELECT '{"min_relative_area": 0.25, "images_loaded": ' || count(DISTINCT image_id) || ', "annotations_read": ' || count(*) || ', "annotations_kept": ' || count(*) FILTER (WHERE kept) || ', "annotations_dropped": ' || count(*) FILTER (WHERE NOT kept)
 || ', "images_affected": ' || count(DISTINCT image_id) FILTER (WHERE NOT kept) || ', "dropped": [' FROM tq)"""


@query(f"WITH {TQ} " + _document_sql(_HEAD, """SELECT image_id, ann_idx, '{"sample_id": ' || image_id || ', "index": ' || ann_idx || ', "relative_area": ' || printf('%.6f', rel) || '}' AS j FROM tq WHERE NOT kept""", "image_id, ann_idx"))
def filter_report_json(spark, sf):
    return reports.filter_report(filtered(spark, sf), PARAMS.min_relative_area)


_VHEAD = """(SELECT '{"visibility_threshold": 0.25, "images_checked": ' || count(DISTINCT image_id) || ', "annotations_checked": ' || count(*) || ', "findings": [' FROM tq WHERE kept)"""


@query(f"WITH {FOUND} " + _document_sql(_VHEAD, """SELECT image_id, ann_idx, '{"sample_id": ' || image_id || ', "annotation_index": ' || ann_idx || ', "visible_fraction": ' || printf('%.6f', visible_fraction) || '}' AS j FROM found""", "image_id, ann_idx"))
def visibility_report_json(spark, sf):
    kept = shapes(spark, sf, predicted=False).where(F.col("role") == images.KEPT)
    return reports.visibility_report(kept, written(findings(spark, sf)), PARAMS.visibility_threshold)


_LHEAD = f"""(SELECT '{{"threshold": {LIKE}, "n_pairs": ' || (SELECT count(*) FROM np) || ', "n_crossing": ' || count(*) || ', "n_affected": ' || (SELECT count(DISTINCT id) FROM (SELECT a AS id FROM lk UNION ALL SELECT b FROM lk)) || ', "crossing_pairs": [' FROM lk)"""


@query(f"WITH {_LEAK} " + _document_sql(_LHEAD, """SELECT a, b, correlation, '{"a": ' || a || ', "b": ' || b || ', "correlation": ' || printf('%.6f', round(correlation, 6)) || ', "split_a": "' || split_a || '", "split_b": "' || split_b || '"}' AS j FROM lk""", "-round(correlation, 6), a, b"))
def leakage_report_json(spark, sf):
    pairs = written(embedding_pairs(spark, sf))
    return reports.leakage_report(pairs, written(duplicates.leakage(pairs, embedding_splits(spark, sf))), LIKE)


@query(f"WITH {_LEAK} SELECT a, b, round(correlation, 6) AS correlation FROM lk ORDER BY round(correlation, 6) DESC, a, b LIMIT 20")
def closest_crossings(spark, sf):
    """The 20 pairs across splits that are most alike: a report whose length is the feature."""
    crossing = duplicates.leakage(embedding_pairs(spark, sf), embedding_splits(spark, sf))
    return crossing.select("a", "b", r("correlation").alias("correlation")).orderBy(F.desc("correlation"), "a", "b").limit(20)


@query(f"WITH {TQ} SELECT image_id, ann_idx, round(rel, 6) AS relative_area FROM tq WHERE NOT kept ORDER BY round(rel, 6), image_id, ann_idx LIMIT 20")
def smallest_dropped(spark, sf):
    """The 20 dropped annotations with the least relative area: a report whose length is the feature."""
    gone = filtered(spark, sf).where("not kept").select("image_id", "ann_idx", r("relative_area").alias("relative_area"))
    return gone.orderBy("relative_area", "image_id", "ann_idx").limit(20)


# ---- formats and order ----
_ENV = "least(nx0, nx1, nx2, nx3) AS l, greatest(nx0, nx1, nx2, nx3) AS rr, least(ny0, ny1, ny2, ny3) AS u, greatest(ny0, ny1, ny2, ny3) AS d"


_VOC = canonical_sql("tq", "image_id, ann_idx", "x", "y", "1.0", "c")


@query(f"""WITH {TQ}, {_VOC}, b AS (SELECT *, {_ENV} FROM tq), e AS (SELECT image_id, ann_idx, avg(x) AS vx, avg(y) AS vy, max(len) FILTER (WHERE v = 0) AS vw, max(len) FILTER (WHERE v = 1) AS vh FROM c GROUP BY image_id, ann_idx)
 SELECT b.image_id, b.ann_idx, round(x0, 4) AS dota_x0, round(y2, 4) AS dota_y2, round((l + rr) / 2, 6) AS cx, round((u + d) / 2, 6) AS cy, round(rr - l, 6) AS w, round(d - u, 6) AS h,
 round(l * width, 4) AS coco_x, round((d - u) * height, 4) AS coco_h, round((l + rr) / 2, 6) AS back_cx, round(d - u, 6) AS back_h, round(vx, 4) AS voc_cx, round(vy, 4) AS voc_cy, round(vw, 4) AS voc_w, round(vh, 4) AS voc_h
 FROM b JOIN e ON b.image_id = e.image_id AND b.ann_idx = e.ann_idx""")
def convert_formats(spark, sf):
    """A quad in each format; back_*: the envelope that comes back from COCO."""
    q, size = F.flatten(F.transform("quad_n", lambda p: F.array(p["x"], p["y"]))), (F.col("width"), F.col("height"))
    to = lambda name: formats.convert(q, "obb_yolo", name, *size)
    t = truth(spark, sf).withColumns({"dota": to("dota"), "box": to("bbox_yolo"), "coco": to("coco"), "voc": to("voc_xml")})
    t = t.withColumn("back", formats.convert(F.col("coco"), "coco", "bbox_yolo", *size))
    at = lambda c, i, name, digits=4: r(F.get(c, F.lit(i)), digits).alias(name)
    box = [at("box", i, n, 6) for i, n in enumerate(("cx", "cy", "w", "h"))]
    voc = [at("voc", i, f"voc_{n}") for i, n in enumerate(("cx", "cy", "w", "h"))]
    return t.select("image_id", "ann_idx", at("dota", 0, "dota_x0"), at("dota", 5, "dota_y2"), *box, at("coco", 0, "coco_x"), at("coco", 3, "coco_h"), at("back", 0, "back_cx", 6), at("back", 3, "back_h", 6), *voc)


_ORDER = canonical_sql("tq", "image_id, ann_idx", "nx", "ny", "width / height", "c")


@query(f"""WITH {TQ}, {_ORDER}, od AS (SELECT image_id, ann_idx, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY v) AS indices FROM c GROUP BY image_id, ann_idx),
 cd AS (SELECT image_id, ann_idx, x + y AS s, row_number() OVER (PARTITION BY image_id, ann_idx ORDER BY x + y, x, y) AS place FROM (SELECT *, max(len) OVER (PARTITION BY image_id, ann_idx) AS most FROM c) WHERE len >= most * 0.95),
 mg AS (SELECT image_id, ann_idx, max(s) FILTER (WHERE place = 2) - max(s) FILTER (WHERE place = 1) AS margin FROM cd GROUP BY image_id, ann_idx)
 SELECT od.image_id, od.ann_idx, indices, round(margin, 6) AS margin, indices = '0 1 2 3' AS canonical FROM od JOIN mg ON od.image_id = mg.image_id AND od.ann_idx = mg.ann_idx""")
def canonical_order(spark, sf):
    aspect = F.col("width") / F.col("height")
    t = truth(spark, sf).withColumn("o", g.canonical_order(F.col("quad_n"), aspect))
    return t.select("image_id", "ann_idx", F.array_join(F.transform("o.order", lambda i: i.cast("string")), " ").alias("indices"), r("o.margin").alias("margin"), g.is_canonical(F.col("quad_n"), aspect).alias("canonical"))


_PN = ", ".join(f"round_even({c}{i} / {'width' if c == 'x' else 'height'} * 1073741824, 0) / 1073741824 AS {c}{i}" for i in range(4) for c in "xy")
_ANCHORED = ", ".join(f"round(max({c}) FILTER (WHERE v = {i}), 6) AS {c}{i}" for i in range(4) for c in "xy")


@query(f"WITH {PQ}, pn AS (SELECT p.image_id, pred_idx, width, height, {_PN} FROM pq p JOIN fx_images i ON p.image_id = i.image_id), {canonical_sql('pn', 'image_id, pred_idx', 'x', 'y', 'width / height', 'c')} SELECT image_id, pred_idx, {_ANCHORED} FROM c GROUP BY image_id, pred_idx")
def reanchor_predictions(spark, sf):
    """Predictions' normalised quads in the canonical order that the true aspect of their image gives."""
    p = pred_polygons(spark, sf).join(fx(spark, sf, "fx_images"), "image_id")
    q = g.canonical(g.to_norm(F.col("q"), F.col("width"), F.col("height")), F.col("width") / F.col("height"))
    return p.withColumn("c", q).select("image_id", "pred_idx", *flat(F.col("c")))


@query(f"""WITH {TQ}, b AS (SELECT *, {_ENV} FROM tq WHERE kept)
 SELECT 'labels/' || image_id || '.txt' AS relative_path, string_agg('0 ' || printf('%.6f %.6f %.6f %.6f', (l + rr) / 2, (u + d) / 2, rr - l, d - u), chr(10) ORDER BY ann_idx) AS content FROM b GROUP BY image_id""")
def export_bbox_yolo(spark, sf):
    return exports.bbox_yolo(prepared(spark, sf, "keep"))
