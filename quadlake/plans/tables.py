"""Queries on cells, duplicates, splits, label files, exports and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fx, table
from ..functions import geometry as g
from ..functions.text import fixed
from ..operators import annotations as an
from ..operators import cells, duplicates, exports, governance, images, splits
from ..params import PARAMS
from ..sources import labels
from .boxes import CORNERS, TN, TQ, XY, _corner, coords, filtered, flat, inter_sql, r, renamed, shapes, truth, turned
from .evaluation import rounded
from .registry import query

# ---- cells and boxes ----
_DEC = """dc AS (SELECT image_id, cell_idx, center_x + (r - l) / 2 * cos(th) - (b - t) / 2 * sin(th) AS cx, center_y + (r - l) / 2 * sin(th) + (b - t) / 2 * cos(th) AS cy, l + r AS w, t + b AS h, th AS theta,
  1 / (1 + exp(-obj_logit)) * (1 / (1 + exp(-cls_logit))) AS score FROM (SELECT *, CASE WHEN 0.5 * atan2(sin2, cos2) < 0 THEN 0.5 * atan2(sin2, cos2) + pi() ELSE 0.5 * atan2(sin2, cos2) END AS th FROM fx_cells))"""


@query(f"WITH {_DEC} SELECT image_id, cell_idx, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h, round(theta, 6) AS theta, round(score, 6) AS score FROM dc")
def decode_cells(spark, sf):
    return rounded(cells.decode(fx(spark, sf, "fx_cells")))


def _nms_sql(boxes: str) -> str:
    """boxes: image_id, box_idx, score and vertices -> kept: image_id, box_idx."""
    return f"""{inter_sql(boxes, boxes, 'a.image_id, a.box_idx AS a_idx, b.box_idx AS b_idx', 'a.image_id = b.image_id AND a.box_idx <> b.box_idx', 'nm')},
 rv AS (SELECT image_id, a_idx AS box_idx, list(b_idx) AS rivals FROM nm WHERE round(iou, 9) > 0.5 GROUP BY ALL),
 od AS (SELECT b.image_id, b.box_idx, coalesce(rivals, []::INT[]) AS rivals, row_number() OVER (PARTITION BY b.image_id ORDER BY score DESC, b.box_idx) AS k FROM {boxes} b LEFT JOIN rv USING (image_id, box_idx)),
 fo AS (SELECT image_id, 0::BIGINT AS k, []::INT[] AS keep FROM (SELECT DISTINCT image_id FROM od)
   UNION ALL SELECT f.image_id, o.k, CASE WHEN len(keep) >= 300 OR list_has_any(keep, rivals) THEN keep ELSE list_append(keep, o.box_idx) END FROM fo f JOIN od o ON f.image_id = o.image_id AND o.k = f.k + 1),
 kept AS (SELECT image_id, unnest(arg_max(keep, k)) AS box_idx FROM fo GROUP BY image_id)"""


_PB = "pb AS (SELECT image_id, pred_idx AS box_idx, score, " + ", ".join(f"{_corner(i, c)} AS {c}{i}" for i in range(4) for c in "xy") + " FROM fx_pred WHERE score >= 0.01)"


@query(f"WITH RECURSIVE {_PB}, {_nms_sql('pb')} SELECT image_id, box_idx FROM kept")
def rotated_nms(spark, sf):
    scored = shapes(spark, sf, truths=False).where(F.col("score") >= PARAMS.inference_confidence)
    return images.suppression(scored).select("image_id", F.col("idx").alias("box_idx"))


_DB = "db AS (SELECT image_id, cell_idx AS box_idx, score, " + ", ".join(f"{_corner(i, c)} AS {c}{i}" for i in range(4) for c in "xy") + " FROM dc WHERE score >= 0.01)"


@query(f"WITH RECURSIVE {_DEC}, {_DB}, {_nms_sql('db')} SELECT image_id, box_idx AS cell_idx, round(score, 6) AS score, {coords()} FROM kept JOIN db USING (image_id, box_idx)")
def detections(spark, sf):
    """Decoded cells over the confidence limit that survive suppression, as quads."""
    b = cells.decode(fx(spark, sf, "fx_cells")).where(F.col("score") >= PARAMS.inference_confidence)
    corners = [c.alias(n) for c, n in zip(turned(*[F.col(c) for c in ("cx", "cy", "w", "h", "theta")]), images.CORNERS, strict=True)]
    out = images.suppression(b.select("image_id", F.lit(images.PREDICTED).alias("role"), F.col("cell_idx").alias("idx"), "score", *corners))
    return out.select("image_id", F.col("idx").alias("cell_idx"), r("score").alias("score"), *[r(c).alias(c) for c in images.CORNERS])


_GRID = """gr AS (SELECT image_id, stride, gx, gy, (gx + 0.5) * stride AS x, (gy + 0.5) * stride AS y FROM fx_images, (VALUES (8), (16), (32)) s(stride), LATERAL (SELECT unnest(range(height // stride)) AS gy) a, LATERAL (SELECT unnest(range(width // stride)) AS gx) b)"""


@query(f"WITH {_GRID} SELECT stride, count(*) AS n, CAST(sum(gx) AS BIGINT) AS sum_gx, CAST(sum(gy) AS BIGINT) AS sum_gy, round(sum(x), 3) AS sum_x, round(sum(y), 3) AS sum_y FROM gr GROUP BY stride")
def anchor_grid(spark, sf):
    a = cells.anchor_grid(fx(spark, sf, "fx_images"))
    return a.groupBy("stride").agg(F.count(F.lit(1)).alias("n"), F.sum("gx").alias("sum_gx"), F.sum("gy").alias("sum_gy"), r(F.sum("x"), 3).alias("sum_x"), r(F.sum("y"), 3).alias("sum_y"))


_POINTS = "pt AS (SELECT image_id, cell_idx AS point, stride, center_x + (cell_idx * 37 % 100) - 50 AS x, center_y + (cell_idx * 53 % 100) - 50 AS y FROM fx_cells)"
_CAND = f"""{_POINTS}, cd AS (SELECT p.image_id, point, ann_idx AS target, abs(round((x - cx) * cos(theta) + (y - cy) * sin(theta), 9)) <= w / 2 AND abs(round(-(x - cx) * sin(theta) + (y - cy) * cos(theta), 9)) <= h / 2 AS inside,
  abs(round(x - cx, 9)) < 2.5 * stride AND abs(round(y - cy, 9)) < 2.5 * stride AS near FROM pt p JOIN fx_truth t ON p.image_id = t.image_id)"""


def _points(spark, sf) -> DataFrame:
    c = fx(spark, sf, "fx_cells")
    return c.select("image_id", F.col("cell_idx").alias("point"), "stride", (F.col("center_x") + F.col("cell_idx") * 37 % 100 - 50).alias("x"), (F.col("center_y") + F.col("cell_idx") * 53 % 100 - 50).alias("y"))


def _targets(spark, sf) -> DataFrame:
    return fx(spark, sf, "fx_truth").withColumnRenamed("ann_idx", "target")


@query(f"WITH {_CAND} SELECT image_id, point, target FROM cd WHERE inside")
def point_in_box(spark, sf):
    return cells.candidates(_points(spark, sf), _targets(spark, sf)).where("inside").select("image_id", "point", "target")


@query(f"WITH {_CAND} SELECT image_id, point, target FROM cd WHERE near")
def near_center(spark, sf):
    return cells.candidates(_points(spark, sf), _targets(spark, sf)).where("near").select("image_id", "point", "target")


_AB = "SELECT *, (w * abs(cos(theta)) + h * abs(sin(theta))) / 2 AS hw, (w * abs(sin(theta)) + h * abs(cos(theta))) / 2 AS hh FROM"


@query(f"""WITH {_DEC}, {_CAND}, p AS ({_AB} dc), t AS ({_AB} fx_truth),
 j AS (SELECT p.image_id, cell_idx AS point, ann_idx AS target, score, greatest(0, least(p.cx + p.hw, t.cx + t.hw) - greatest(p.cx - p.hw, t.cx - t.hw)) * greatest(0, least(p.cy + p.hh, t.cy + t.hh) - greatest(p.cy - p.hh, t.cy - t.hh)) AS inter,
   4 * p.hw * p.hh + 4 * t.hw * t.hh AS total FROM p JOIN t ON p.image_id = t.image_id),
 c AS (SELECT j.image_id, j.point, j.target, round(inter / (total - inter), 9) AS iou, score, coalesce(inside OR near, FALSE) AS c FROM j LEFT JOIN cd ON j.image_id = cd.image_id AND j.point = cd.point AND j.target = cd.target),
 k AS (SELECT *, round(-ln(greatest(score, 1e-8)) - 3 * ln(greatest(iou, 1e-8)) + CASE WHEN c THEN 0 ELSE 1e5 END, 9) AS cost, CASE WHEN c THEN iou ELSE 0 END AS own FROM c),
 b AS (SELECT *, row_number() OVER (PARTITION BY image_id, target ORDER BY own DESC, point) AS best, row_number() OVER (PARTITION BY image_id, target ORDER BY cost, point) AS rk FROM k),
 n AS (SELECT *, greatest(1, floor(round(sum(CASE WHEN best <= 10 THEN own ELSE 0 END) OVER (PARTITION BY image_id, target), 6))) AS k FROM b),
 f AS (SELECT *, row_number() OVER (PARTITION BY image_id, point ORDER BY cost, target) AS first FROM n WHERE rk <= k)
 SELECT image_id, point, target, round(iou, 6) AS iou FROM f WHERE first = 1""")
def dynamic_k_assign(spark, sf):
    predicted = cells.decode(fx(spark, sf, "fx_cells")).withColumnRenamed("cell_idx", "point")
    targets = _targets(spark, sf)
    return rounded(cells.dynamic_k(predicted, targets, cells.candidates(_points(spark, sf), targets)))


@query(f"""WITH p AS ({_AB} fx_pred), t AS ({_AB} fx_truth),
 j AS (SELECT p.theta AS pt, t.theta AS tt, greatest(t.w, t.h) / least(t.w, t.h) AS ratio, greatest(0, least(p.cx + p.hw, t.cx + t.hw) - greatest(p.cx - p.hw, t.cx - t.hw)) * greatest(0, least(p.cy + p.hh, t.cy + t.hh) - greatest(p.cy - p.hh, t.cy - t.hh)) AS inter,
   4 * p.hw * p.hh + 4 * t.hw * t.hh AS total FROM p JOIN t ON p.image_id = t.image_id AND p.pred_idx = t.ann_idx),
 u AS (SELECT *, least(1, greatest(0, (ratio - 1) / (1.1 - 1))) AS u FROM j)
 SELECT count(*) AS n, round(avg(1 - inter / (total - inter)), 6) AS iou_loss, round(sum(u * u * (3 - 2 * u) * (1 - cos(2 * (pt - tt)))) / count(*), 6) AS angle_loss FROM u""")
def pair_losses(spark, sf):
    box = lambda n: F.struct("cx", "cy", "w", "h", "theta").alias(n)
    p = fx(spark, sf, "fx_pred").select("image_id", F.col("pred_idx").alias("ann_idx"), box("p"))
    t = fx(spark, sf, "fx_truth").select("image_id", "ann_idx", box("t"))
    return rounded(cells.pair_losses(p.join(t, ["image_id", "ann_idx"])))


# ---- duplicates ----
LIKE = 0.35
_SIG = """sg AS (SELECT id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS sig FROM
  (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE - list_avg(list_transform(embedding, lambda z: z::DOUBLE))) AS c FROM embeddings))"""
_NP = f"{_SIG}, np AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.sig, b.sig) AS correlation FROM sg a JOIN sg b ON a.id < b.id AND list_inner_product(a.sig, b.sig) > {LIKE})"
_SPLIT = "sl AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'valid' ELSE 'test' END AS split FROM embeddings)"
_LEAK = f"{_NP}, {_SPLIT}, lk AS (SELECT np.*, x.split AS split_a, y.split AS split_b FROM np JOIN sl x ON np.a = x.id JOIN sl y ON np.b = y.id WHERE x.split <> y.split)"


def signature_table(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), duplicates.centered_unit(F.col("embedding").cast("array<double>")).alias("sig"))


def embedding_pairs(spark, sf) -> DataFrame:
    return duplicates.near_pairs(signature_table(spark, sf), LIKE)


def embedding_splits(spark, sf) -> DataFrame:
    k = F.col("vec_id") % 10
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(k < 7, "train").when(k < 9, "valid").otherwise("test").alias("split"))


@query(f"WITH {_SIG} SELECT id, len(sig) AS n, round(sig[1], 6) AS first, round(sig[2], 6) AS second, round(list_sum(list_transform(sig, lambda x: abs(x))), 6) AS l1 FROM sg")
def signatures(spark, sf):
    s = signature_table(spark, sf)
    l1 = F.aggregate("sig", F.lit(0.0), lambda a, x: a + F.abs(x))
    return s.select("id", F.size("sig").cast("long").alias("n"), r(F.get("sig", F.lit(0))).alias("first"), r(F.get("sig", F.lit(1))).alias("second"), r(l1).alias("l1"))


@query(f"WITH {_NP} SELECT a, b, round(correlation, 6) AS correlation FROM np")
def near_duplicate_pairs(spark, sf):
    return rounded(embedding_pairs(spark, sf))


_GROUPS = "ed AS (SELECT a, b FROM np UNION ALL SELECT b, a FROM np), re AS (SELECT DISTINCT a AS id, a AS o FROM ed UNION SELECT re.id, ed.b FROM re JOIN ed ON re.o = ed.a), gp AS (SELECT id, min(o) AS label FROM re GROUP BY id)"


@query(f"WITH RECURSIVE {_NP}, {_GROUPS} SELECT id, label FROM gp")
def duplicate_groups(spark, sf):
    return duplicates.groups(embedding_pairs(spark, sf).select("a", "b"))


@query(f"WITH RECURSIVE {_LEAK}, {_GROUPS} SELECT (SELECT count(*) FROM np) AS pairs, (SELECT count(*) FROM lk) AS crossing, (SELECT count(DISTINCT id) FROM (SELECT a AS id FROM lk UNION ALL SELECT b FROM lk)) AS affected, (SELECT count(DISTINCT label) FROM gp) AS groups")
def duplicate_report(spark, sf):
    pairs = embedding_pairs(spark, sf)
    crossing = duplicates.leakage(pairs, embedding_splits(spark, sf))
    n = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    c = crossing.agg(F.count(F.lit(1)).alias("crossing"))
    a = crossing.select(F.explode(F.array("a", "b")).alias("id")).agg(F.count_distinct("id").alias("affected"))
    return n.crossJoin(c).crossJoin(a).crossJoin(duplicates.groups(pairs.select("a", "b")).agg(F.count_distinct("label").alias("groups")))


@query(f"WITH {_LEAK} SELECT a, b, split_a, split_b, round(correlation, 6) AS correlation FROM lk")
def split_leakage(spark, sf):
    return rounded(duplicates.leakage(embedding_pairs(spark, sf), embedding_splits(spark, sf)))


@query(f"WITH {_LEAK}, e AS (SELECT split_a AS split, a AS id FROM lk UNION ALL SELECT split_b, b FROM lk) SELECT split, count(*) AS pairs, count(DISTINCT id) AS images FROM e GROUP BY split")
def leakage_by_split(spark, sf):
    return duplicates.leakage_by_split(duplicates.leakage(embedding_pairs(spark, sf), embedding_splits(spark, sf)))


# ---- splits ----
def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"))


_KEYS = "SELECT doc_id, CAST(doc_id AS VARCHAR) AS own, source AS directory, lang AS manifest, 'img' || CAST(doc_id % 7 AS VARCHAR) AS prefix FROM documents"


@query(_KEYS)
def group_key(spark, sf):
    d = table(spark, sf, "documents").withColumn("name", F.concat(F.lit("img"), F.col("doc_id") % 7, F.lit("_"), F.col("doc_id")))
    sample = F.col("doc_id").cast("string")
    return d.select("doc_id", splits.group_key("none", sample).alias("own"), splits.group_key("directory", sample, directory=F.col("source")).alias("directory"), splits.group_key("manifest", sample, manifest=F.col("lang")).alias("manifest"), splits.group_key("prefix", F.col("name"), regex="^(img[0-9]+)_").alias("prefix"))


def _cut_sql(groups: str, seed: int, out: str) -> str:
    return f"""{out}_r AS (SELECT grp, row_number() OVER (ORDER BY md5('{seed}:' || CAST(grp AS VARCHAR)), grp) AS pos, count(*) OVER () AS total FROM {groups}),
 {out}_c AS (SELECT *, least(round_even(total * 0.7, 0), total) AS nt FROM {out}_r),
 {out} AS (SELECT grp, CASE WHEN pos <= nt THEN 'train' WHEN pos <= nt + least(round_even(total * 0.15, 0), total - nt) THEN 'valid' ELSE 'test' END AS split FROM {out}_c)"""


@query(f"WITH gs AS (SELECT DISTINCT c_nationkey AS grp FROM customer), {_cut_sql('gs', PARAMS.seed, 'ct')} SELECT c_custkey AS id, grp, split FROM customer JOIN ct ON c_nationkey = grp")
def random_split(spark, sf):
    return splits.random_split(customers(spark, sf))


@query(f"WITH gs AS (SELECT DISTINCT c_nationkey AS grp FROM customer), {_cut_sql('gs', PARAMS.seed, 'ct')} SELECT 'c' || c_custkey AS id, CAST(grp AS VARCHAR) AS grp, split FROM customer JOIN ct ON c_nationkey = grp")
def create_split(spark, sf):
    """A new split by the groups of a manifest."""
    c = customers(spark, sf).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.col("grp").cast("string").alias("grp"))
    return splits.create_split(c.select("id"), "manifest", manifest=c)


def known_customers(spark, sf) -> DataFrame:
    k = F.col("grp") % 10
    return customers(spark, sf).where("grp < 20 and id % 3 <> 0").select("id", F.when(k < 7, "train").when(k < 9, "valid").otherwise("test").alias("split"))


_KNOWN = "kn AS (SELECT c_custkey AS id, c_nationkey AS grp, CASE WHEN c_nationkey % 10 < 7 THEN 'train' WHEN c_nationkey % 10 < 9 THEN 'valid' ELSE 'test' END AS split FROM customer WHERE c_nationkey < 20 AND c_custkey % 3 <> 0)"


@query(f"""WITH {_KNOWN}, nw AS (SELECT c_custkey AS id, c_nationkey AS grp FROM customer WHERE c_custkey NOT IN (SELECT id FROM kn)), og AS (SELECT grp, min(split) AS split FROM kn GROUP BY grp),
 fr AS (SELECT DISTINCT grp FROM nw WHERE grp NOT IN (SELECT grp FROM og)), {_cut_sql('fr', PARAMS.seed + 1, 'ct')}
 SELECT id, nw.grp, split, 'inherited' AS how FROM nw JOIN og ON nw.grp = og.grp UNION ALL SELECT id, nw.grp, split, 'fresh' FROM nw JOIN ct ON nw.grp = ct.grp""")
def extend_splits(spark, sf):
    return splits.extend_splits(customers(spark, sf), known_customers(spark, sf))


@query("""WITH RECURSIVE s AS (SELECT c_nationkey AS grp, count(*) AS size FROM customer GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, grp) AS k FROM s),
 f AS (SELECT 0::BIGINT AS k, NULL::INT AS grp, NULL::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
   UNION ALL SELECT o.k, o.grp, list_position(load, list_min(load)) - 1, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + o.size ELSE x END) FROM f JOIN o ON o.k = f.k + 1)
 SELECT c_custkey AS id, c_nationkey AS grp, CAST(fold AS INT) AS fold FROM customer JOIN f ON c_nationkey = f.grp""")
def grouped_folds(spark, sf):
    return splits.grouped_folds(customers(spark, sf))


@query(f"SELECT id FROM (SELECT c_custkey AS id FROM customer ORDER BY md5('{PARAMS.seed}:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 12) ORDER BY id")
def fixed_sample(spark, sf):
    """The twelve samples that are shown at every validation: a fixed number is the feature."""
    c = customers(spark, sf).select("id")
    return c.orderBy(splits.shuffle_order(F.col("id"), PARAMS.seed), "id").limit(12).orderBy("id")


_ASSIGNED = "ag AS (SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 1000000 ELSE 0 END AS id FROM labels), dc AS (SELECT doc_id AS id FROM documents)"


def assigned(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels")
    return lab.select((F.col("doc_id") + F.when(F.col("doc_id") % 50 == 0, 1000000).otherwise(0)).alias("id"))


def doc_ids(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"))


@query(f"WITH {_ASSIGNED} SELECT id, 'absent' AS problem FROM ag WHERE id NOT IN (SELECT id FROM dc) UNION ALL SELECT id, 'unassigned' FROM dc WHERE id NOT IN (SELECT id FROM ag)")
def split_integrity(spark, sf):
    return splits.integrity(doc_ids(spark, sf), assigned(spark, sf))


@query("SELECT o_custkey AS id, count(DISTINCT o_orderkey % 3) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def split_clashes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("split"))
    return splits.clashes(o, "id")


@query("SELECT c_nationkey AS grp, count(DISTINCT o_orderkey % 3) AS splits FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def group_clashes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("split"))
    return splits.clashes(o.join(customers(spark, sf), "id"), "grp")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_samples(spark, sf):
    return doc_ids(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query(f"WITH {_ASSIGNED} SELECT coalesce(d.id, a.id) AS id, CASE WHEN d.id IS NULL THEN 'left' ELSE 'right' END AS missing FROM dc d FULL JOIN (SELECT DISTINCT id FROM ag) a ON d.id = a.id WHERE d.id IS NULL OR a.id IS NULL")
def pairing_orphans(spark, sf):
    return labels.orphans(doc_ids(spark, sf), assigned(spark, sf), "id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- label files ----
def _micro(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST(abs({v}) // 1000000 AS VARCHAR) || '.' || lpad(CAST(abs({v}) % 1000000 AS VARCHAR), 6, '0'))"


_V = {f"{c}{i}": f"CAST(round(n{c}{i} * 1000000, 0) AS BIGINT)" for i in range(4) for c in "xy"}
_TOK = " || ' ' || ".join(_micro(_V[f"{c}{i}"]) for i in range(4) for c in "xy")
_BROKEN = f"""CASE WHEN ann_idx > 0 OR image_id // 10 % 23 > 6 OR image_id // 10 % 23 = 0 THEN '0 ' || t WHEN image_id // 10 % 23 = 1 THEN '0 ' || left(t, len(t) - 9) WHEN image_id // 10 % 23 = 2 THEN '0 0.1234567890123456789' || substr(t, 9)
 WHEN image_id // 10 % 23 = 3 THEN '0 abc' || substr(t, 9) WHEN image_id // 10 % 23 = 4 THEN '1.5 ' || t WHEN image_id // 10 % 23 = 5 THEN '0 1.700000' || substr(t, 9) ELSE '  ' END"""
_LINES = f"{TN}, ln AS (SELECT image_id, ann_idx, {_BROKEN} AS line FROM (SELECT image_id, ann_idx, {_TOK} AS t FROM tn)), fl AS (SELECT image_id, 'labels/' || CAST(image_id AS VARCHAR) || '.txt' AS path, string_agg(line, chr(10) ORDER BY ann_idx) AS content FROM ln GROUP BY image_id)"
_PARSE = f"""{_LINES}, sp AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) + 1 AS line_no FROM fl),
 tk AS (SELECT path, line_no, string_split(trim(line), ' ') AS t FROM sp WHERE trim(line) <> ''),
 dg AS (SELECT *, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN len(trim(regexp_replace(x, '[^0-9]', '', 'g'), '0')) END) AS d, list_transform(t, lambda x: try_cast(x AS DOUBLE)) AS v FROM tk),
 ps AS (SELECT *, CASE WHEN len(t) <> 9 THEN 'tokens' WHEN len(list_filter(d, lambda x: x IS NULL)) > 0 THEN 'number' WHEN list_max(d) > 17 THEN 'digits' WHEN v[1] < 0 OR v[1] <> floor(v[1]) THEN 'class'
   WHEN list_min(v[2:9]) < -0.5 OR list_max(v[2:9]) > 1.5 THEN 'range' END AS problem FROM dg)"""


def label_files(spark, sf) -> DataFrame:
    """A label file for each image, built from the truths, some with a broken first line."""
    def micro(v):
        v = F.round(v * 1000000).cast("long")
        return F.concat(F.when(v < 0, "-").otherwise(""), F.floor(F.abs(v) / 1000000).cast("string"), F.lit("."), F.lpad((F.abs(v) % 1000000).cast("string"), 6, "0"))

    t = truth(spark, sf).withColumn("t", F.concat_ws(" ", *[micro(F.get("quad_n", F.lit(i))[c]) for i in range(4) for c in "xy"]))
    k = F.floor(F.col("image_id") / 10) % 23
    rest = F.expr("substring(t, 9)")
    line = (
        F.when((F.col("ann_idx") > 0) | (k > 6) | (k == 0), F.concat(F.lit("0 "), "t")).when(k == 1, F.concat(F.lit("0 "), F.expr("left(t, length(t) - 9)")))
        .when(k == 2, F.concat(F.lit("0 0.1234567890123456789"), rest)).when(k == 3, F.concat(F.lit("0 abc"), rest)).when(k == 4, F.concat(F.lit("1.5 "), "t")).when(k == 5, F.concat(F.lit("0 1.700000"), rest)).otherwise("  ")
    )
    lines = t.withColumn("line", line).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_idx", "line"))).alias("ls"))
    return lines.select("image_id", F.concat(F.lit("labels/"), F.col("image_id"), F.lit(".txt")).alias("path"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


@query(f"WITH {_PARSE} SELECT path, line_no, CAST(v[1] AS INT) AS class_id, {', '.join(f'round(v[{2 * i + 2 + j}], 6) AS {c}{i}' for i in range(4) for j, c in enumerate('xy'))} FROM ps WHERE problem IS NULL")
def read_obb_lines(spark, sf):
    return labels.parse_lines(label_files(spark, sf)).where("problem is null").select("path", F.col("line_no").cast("long").alias("line_no"), "class_id", *flat(F.col("quad")))


@query(f"WITH {_PARSE} SELECT path, line_no, problem FROM ps WHERE problem IS NOT NULL")
def label_problems(spark, sf):
    return labels.parse_lines(label_files(spark, sf)).where("problem is not null").select("path", F.col("line_no").cast("long").alias("line_no"), "problem")


@query(f"WITH {_PARSE} SELECT path, line_no, array_to_string(list_transform(d, lambda x: coalesce(CAST(x AS VARCHAR), '?')), ' ') AS digits FROM ps")
def significant_digits(spark, sf):
    p = labels.parse_lines(label_files(spark, sf))
    d = F.transform("tokens", lambda t: F.coalesce(labels.significant_digits(t).cast("string"), F.lit("?")))
    return p.select("path", F.col("line_no").cast("long").alias("line_no"), F.array_join(d, " ").alias("digits"))




@query(f"""WITH {TQ}, b AS (SELECT image_id, ann_idx, width, height, least(nx0, nx1, nx2, nx3) AS l, greatest(nx0, nx1, nx2, nx3) AS rr, least(ny0, ny1, ny2, ny3) AS u, greatest(ny0, ny1, ny2, ny3) AS d FROM tq)
 SELECT image_id, ann_idx, 0.0::DOUBLE AS obb_yolo, 0.0::DOUBLE AS dota, TRUE AS lossless, round((l + rr) / 2, 6) AS cx, round((u + d) / 2, 6) AS cy, round(rr - l, 6) AS w, round(d - u, 6) AS h FROM b""")
def convert_roundtrip(spark, sf):
    """The error of a round trip through each quad format, rounded to the text's six decimals, and the envelope that the box
    formats keep of a quad."""
    t = truth(spark, sf)
    px = F.col("quad_px")
    text = F.transform(px, lambda p: F.struct(fixed(p["x"], 6).cast("double").alias("x"), fixed(p["y"], 6).cast("double").alias("y")))
    back = g.to_norm(text, F.col("width"), F.col("height"))
    yolo = F.transform("quad_n", lambda p: F.struct(p["x"].cast("string").cast("double").alias("x"), p["y"].cast("string").cast("double").alias("y")))
    error = lambda q: F.array_max(F.zip_with(q, "quad_n", lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]))))
    x0, y0, x1, y1 = g.bounds(F.col("quad_n"))
    return t.select("image_id", "ann_idx", r(error(yolo)).alias("obb_yolo"), r(error(back)).alias("dota"), (error(yolo) == 0).alias("lossless"), r((x0 + x1) / 2).alias("cx"), r((y0 + y1) / 2).alias("cy"), r(x1 - x0).alias("w"), r(y1 - y0).alias("h"))


def prepared(spark, sf, policy: str) -> DataFrame:
    return an.prepare(filtered(spark, sf), policy).withColumn("class_name", F.lit("note"))


@query(f"WITH {TQ} SELECT 'labels/' || CAST(image_id AS VARCHAR) || '.txt' AS relative_path, count(*) AS lines FROM tq WHERE kept GROUP BY image_id")
def export_obb_yolo(spark, sf):
    """Files and lines; the text itself differs between engines in how many digits a number needs."""
    out = exports.obb_yolo(prepared(spark, sf, "clip"))
    return out.select("relative_path", F.size(F.split("content", "\n")).cast("long").alias("lines"))


@query(f"""WITH {TQ}, l AS (SELECT image_id, ann_idx, {" || ' ' || ".join(f"printf('%.6f', n{c}{i} * {'width' if c == 'x' else 'height'})" for i in range(4) for c in 'xy')} || ' note 0' AS line FROM tq WHERE kept)
 SELECT 'labelTxt/' || CAST(image_id AS VARCHAR) || '.txt' AS relative_path, string_agg(line, chr(10) ORDER BY ann_idx) AS content FROM l GROUP BY image_id""")
def export_dota(spark, sf):
    return exports.dota(prepared(spark, sf, "keep"))


@query(f"WITH {TQ} SELECT 'Annotations/' || CAST(image_id AS VARCHAR) || '.xml' AS relative_path, count(*) AS objects FROM tq WHERE kept GROUP BY image_id")
def export_voc(spark, sf):
    out = exports.voc(prepared(spark, sf, "keep"))
    return out.select("relative_path", (F.size(F.split("content", "<object>")) - 1).cast("long").alias("objects"))


@query(f"""WITH {TQ}, k AS (SELECT *, row_number() OVER (ORDER BY image_id, ann_idx) AS id, dense_rank() OVER (ORDER BY image_id) AS image FROM tq WHERE kept)
 SELECT id, image, image_id, class_id, round(least(x0, x1, x2, x3), 4) AS x, round(least(y0, y1, y2, y3), 4) AS y, round(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3), 4) AS w, round(greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3), 4) AS h FROM k""")
def export_coco(spark, sf):
    return exports.coco_annotations(prepared(spark, sf, "keep")).drop("area")


# ---- runs ----
def components(spark, sf) -> DataFrame:
    return fx(spark, sf, "fx_components").withColumn("sources", F.array("source_license"))


def run_verdicts(spark, sf) -> DataFrame:
    return governance.verdicts(fx(spark, sf, "fx_runs"), components(spark, sf))


_LEFT = "('AGPL-3.0', 'GPL-3.0', 'GPL-2.0', 'SSPL-1.0')"


def _why(p: str, role: str) -> str:
    return f"""list_filter([CASE WHEN NOT {p}.production_ready THEN '{role} ' || {p}.name || ' is not production ready (licence ' || {p}.license || ')' END, CASE WHEN {p}.license IN {_LEFT} THEN '{role} ' || {p}.name || ' has licence ' || {p}.license END,
 CASE WHEN {p}.source_license IN {_LEFT} THEN '{role} ' || {p}.name || ' has a source with licence ' || {p}.source_license END], lambda x: x IS NOT NULL)"""


_VERDICTS = f"""vd AS (SELECT r.*, d.name, d.license, coalesce(d.production_ready, FALSE) AND NOT coalesce(NOT s.production_ready OR s.license IN {_LEFT} OR s.source_license IN {_LEFT}, FALSE) AS production_ready,
  list_concat({_why('d', 'detector')}, CASE WHEN s.component_id IS NULL THEN [] ELSE {_why('s', 'dataset')} END) AS reasons, git_available AND NOT git_dirty AS reproducible,
  CASE WHEN NOT git_available THEN 'git is not available' WHEN git_dirty THEN 'uncommitted changes' END AS provenance
  FROM fx_runs r LEFT JOIN fx_components d ON r.detector_id = d.component_id LEFT JOIN fx_components s ON r.dataset_id = s.component_id)"""


@query(f"WITH {_VERDICTS} SELECT run_id, unnest(reasons) AS blocker FROM vd")
def license_blockers(spark, sf):
    return run_verdicts(spark, sf).select("run_id", F.explode("license_blockers").alias("blocker"))


@query(f"WITH {_VERDICTS} SELECT run_id, production_ready, reproducible FROM vd")
def production_ready(spark, sf):
    return run_verdicts(spark, sf).select("run_id", "production_ready", "reproducible")


_CHAIN = "ch AS (SELECT run_id, k AS place, (run_id * 7 + 3 * k) % 10 AS dataset_id FROM fx_runs, LATERAL (SELECT unnest(range(run_id % 4)) AS k))"


@query(f"""WITH {_CHAIN}, w AS (SELECT ch.run_id, place, {_why('s', 'dataset')} AS why, NOT s.production_ready OR s.license IN {_LEFT} OR s.source_license IN {_LEFT} AS bad FROM ch JOIN fx_components s ON ch.dataset_id = s.component_id),
 g AS (SELECT run_id, flatten(list(why ORDER BY place)) AS why, bool_or(bad) AS bad FROM w GROUP BY run_id)
 SELECT r.run_id, d.production_ready AND NOT coalesce(bad, FALSE) AS production_ready, array_to_string(list_concat({_why('d', 'detector')}, coalesce(g.why, [])), '; ') AS blockers
 FROM fx_runs r JOIN fx_components d ON r.detector_id = d.component_id LEFT JOIN g ON r.run_id = g.run_id""")
def chain_verdicts(spark, sf):
    """Runs on chains of none to three datasets."""
    runs = fx(spark, sf, "fx_runs")
    none = F.array().cast("array<long>")
    places = F.when(F.col("run_id") % 4 > 0, F.sequence(F.lit(0).cast("long"), F.col("run_id").cast("long") % 4 - 1)).otherwise(none)
    chain = runs.select("run_id", F.explode(places).alias("place")).withColumn("dataset_id", (F.col("run_id") * 7 + 3 * F.col("place")) % 10)
    v = governance.verdicts(runs, components(spark, sf), chain)
    return v.select("run_id", "production_ready", F.array_join("license_blockers", "; ").alias("blockers"))


@query(f"SELECT component_id, 'ready with a copyleft source' AS violation FROM fx_components WHERE production_ready AND source_license IN {_LEFT}")
def dataset_violations(spark, sf):
    return governance.dataset_violations(components(spark, sf))


@query(f"""WITH {_VERDICTS} SELECT run_id, name AS detector, license, CASE WHEN production_ready THEN 'yes' ELSE 'NOT READY' END AS ready, CASE WHEN reproducible THEN 'yes' ELSE 'NO' END AS reproducible,
 CASE WHEN ci_half IS NULL THEN printf('%.3f no CI', map50) ELSE printf('%.3f [%.3f,%.3f]', map50, map50 - ci_half, map50 + ci_half) END AS map50 FROM vd""")
def compare_runs(spark, sf):
    v = run_verdicts(spark, sf)
    return v.select("run_id", F.col("d_name").alias("detector"), F.col("d_license").alias("license"), F.when(F.col("production_ready"), "yes").otherwise("NOT READY").alias("ready"), F.when(F.col("reproducible"), "yes").otherwise("NO").alias("reproducible"), governance.cell(F.col("map50"), F.col("ci_half").cast("double")).alias("map50"))


@query(f"WITH {_VERDICTS} SELECT CAST(run_id AS VARCHAR) AS run, unnest(reasons) AS reason FROM vd WHERE NOT production_ready UNION ALL SELECT DISTINCT 'unreproducible', provenance FROM vd WHERE NOT reproducible")
def flagged_runs(spark, sf):
    v = run_verdicts(spark, sf)
    why = v.where("not reproducible").select(F.lit("unreproducible").alias("run"), F.explode("provenance_blockers").alias("reason")).distinct()
    return v.where("not production_ready").select(F.col("run_id").cast("string").alias("run"), F.explode("license_blockers").alias("reason")).unionByName(why)


@query(f"WITH {_VERDICTS} SELECT component_id, name FROM fx_components WHERE production_ready")
def production_candidates(spark, sf):
    return components(spark, sf).where("production_ready").select("component_id", "name").orderBy("name")


@query(f"WITH {_VERDICTS} SELECT 'run-' || lpad(CAST(run_id AS VARCHAR), 6, '0') AS name, license, production_ready, CASE WHEN ci_half IS NULL THEN NULL ELSE run_id END AS newest FROM vd")
def discover_runs(spark, sf):
    """Run records as JSON text, some of an older form that lacks a field, read with one explicit schema."""
    v = run_verdicts(spark, sf)
    name = F.concat(F.lit("run-"), F.lpad(F.col("run_id").cast("string"), 6, "0"))
    doc = F.to_json(F.struct(name.alias("name"), F.struct(F.col("d_name").alias("name"), F.col("d_license").alias("license")).alias("detector"), "production_ready", F.when(F.col("ci_half").isNotNull(), F.col("run_id")).alias("newest")))
    parsed = v.select(F.from_json(doc, labels.RUN_SCHEMA + ", newest long").alias("j"))
    return parsed.select("j.name", F.col("j.detector.license").alias("license"), "j.production_ready", "j.newest").orderBy(F.desc("name"))


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '?' ELSE 'run-' || CAST(user_id % 5 AS VARCHAR) END AS run, CASE WHEN event_id % 50 = 0 THEN '[unreadable line]' ELSE event_type END AS reason, event_id % 50 <> 0 AS readable FROM events""")
def test_access_log(spark, sf):
    e = table(spark, sf, "events")
    doc = F.to_json(F.struct(F.concat(F.lit("run-"), F.col("user_id") % 5).alias("run"), F.col("event_type").alias("reason")))
    lines = e.select("event_id", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), doc)).otherwise(doc).alias("value"))
    return labels.read_test_accesses(lines).drop("utc")
