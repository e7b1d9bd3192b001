"""Queries on predictions: matching, average precision, crops and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import bootstrap, crops, detection, images
from ..params import COCO_THRESHOLDS, PARAMS
from ..scratch import written
from .boxes import IGN, IOA, IOU, KEPT, PQ, TQ, XY, canonical_sql, covered_sql, r, shapes
from .registry import query

THRESHOLDS = "[" + ", ".join(f"{t}::DOUBLE" for t in COCO_THRESHOLDS) + "]"


def outcomes(spark, sf, at=(PARAMS.match_iou,)) -> tuple[DataFrame, DataFrame]:
    """A narrow row for each prediction, and one row with the number of truths. Written: the shuffle of boxes ends before what starts
    from them begins."""
    found = written(images.outcomes(shapes(spark, sf), at))
    return found.where("image_id is not null").drop("truths"), found.agg(F.coalesce(F.sum("truths"), F.lit(0)).alias("n_truths"))


def outcome(name: str) -> Column:
    """1 if a row of outcomes() at one threshold has this outcome, else 0."""
    return {"tp": F.col("hits") != 0, "ignored": F.col("excused") != 0, "fp": (F.col("hits") == 0) & (F.col("excused") == 0)}[name].cast("long")


# The greedy step in the other engine: pairs in order, one for each step of a recursion that carries what is taken.
def greedy_sql(at: str) -> str:
    return f"""th AS (SELECT unnest({at}) AS threshold),
 cand AS (SELECT threshold, i.image_id, i.pred_idx, truth_idx, iou, p.score, row_number() OVER (PARTITION BY threshold, i.image_id ORDER BY p.score DESC, i.pred_idx, round(iou, 9) DESC, truth_idx) AS k
   FROM iou0 i JOIN pq p ON i.image_id = p.image_id AND i.pred_idx = p.pred_idx, th WHERE inter > 0 AND round(iou, 9) >= threshold),
 fold AS (SELECT threshold, image_id, 0::BIGINT AS k, []::INT[] AS ps, []::INT[] AS ts FROM (SELECT DISTINCT threshold, image_id FROM cand)
   UNION ALL SELECT f.threshold, f.image_id, c.k, CASE WHEN list_contains(ps, c.pred_idx) OR list_contains(ts, c.truth_idx) THEN ps ELSE list_append(ps, c.pred_idx) END,
     CASE WHEN list_contains(ps, c.pred_idx) OR list_contains(ts, c.truth_idx) THEN ts ELSE list_append(ts, c.truth_idx) END
   FROM fold f JOIN cand c ON f.threshold = c.threshold AND f.image_id = c.image_id AND c.k = f.k + 1),
 ends AS (SELECT threshold, image_id, arg_max(ps, k) AS ps, arg_max(ts, k) AS ts FROM fold GROUP BY threshold, image_id),
 pairs AS (SELECT threshold, image_id, unnest(ps) AS pred_idx, unnest(ts) AS truth_idx FROM ends),
 matched AS (SELECT m.threshold, m.image_id, m.pred_idx, m.truth_idx, c.iou, c.score FROM pairs m JOIN cand c ON m.threshold = c.threshold AND m.image_id = c.image_id AND m.pred_idx = c.pred_idx AND m.truth_idx = c.truth_idx)"""


def outcome_sql(at: str) -> str:
    return f"""{TQ}, {KEPT}, {PQ}, {IOU}, {IOA}, {greedy_sql(at)},
 oc AS (SELECT t.threshold, p.image_id, p.pred_idx, p.score, CASE WHEN m.truth_idx IS NOT NULL THEN 'tp' WHEN a.covered > 0 AND round(a.covered / a.area, 9) >= t.threshold THEN 'ignored' ELSE 'fp' END AS outcome, m.truth_idx
   FROM pq p CROSS JOIN th t JOIN ioa a ON p.image_id = a.image_id AND p.pred_idx = a.pred_idx LEFT JOIN matched m ON t.threshold = m.threshold AND p.image_id = m.image_id AND p.pred_idx = m.pred_idx)"""


ONE = "[0.5::DOUBLE]"
STATS = """st AS (SELECT th.threshold, i.image_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(ig, 0) AS ignored, coalesce(n, 0) AS n_truths FROM fx_images i CROSS JOIN th
   LEFT JOIN (SELECT threshold, image_id, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'ignored') AS ig FROM oc GROUP BY ALL) o
   ON o.threshold = th.threshold AND o.image_id = i.image_id LEFT JOIN (SELECT image_id, count(*) AS n FROM kq GROUP BY image_id) k ON k.image_id = i.image_id)"""
AP = """pr AS (SELECT threshold, image_id, pred_idx, score, hit, sum(hit) OVER w AS tp, count(*) OVER w AS seen FROM (SELECT *, CASE WHEN outcome = 'tp' THEN 1 ELSE 0 END AS hit FROM oc WHERE outcome <> 'ignored')
   WINDOW w AS (PARTITION BY threshold ORDER BY score DESC, image_id, pred_idx ROWS UNBOUNDED PRECEDING)),
 cv AS (SELECT *, tp / seen AS precision, tp / (SELECT count(*) FROM kq) AS recall FROM pr),
 rp AS (SELECT i, CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i * 0.01::DOUBLE END AS rec FROM range(101) x(i)),
 ap AS (SELECT threshold, sum(coalesce(best, 0)) / 101 AS ap FROM (SELECT th.threshold, i, max(precision) AS best FROM th CROSS JOIN rp LEFT JOIN cv ON cv.threshold = th.threshold AND recall >= rec GROUP BY ALL) GROUP BY threshold)"""


@query(f"WITH RECURSIVE {TQ}, {KEPT}, {PQ}, {IOU}, {greedy_sql(ONE)} SELECT image_id, pred_idx, truth_idx, round(iou, 6) AS iou, score FROM matched")
def greedy_match(spark, sf):
    return images.matches(shapes(spark, sf)).withColumn("iou", r("iou"))


@query(f"WITH RECURSIVE {outcome_sql(THRESHOLDS)}, {STATS} SELECT * FROM st")
def image_stats(spark, sf):
    return images.image_stats(shapes(spark, sf), COCO_THRESHOLDS)


@query(f"WITH RECURSIVE {outcome_sql(ONE)}, {AP} SELECT image_id, pred_idx, score, hit, CAST(tp AS BIGINT) AS tp, seen, round(precision, 6) AS precision, round(recall, 6) AS recall FROM cv")
def pr_curve(spark, sf):
    found, truths = outcomes(spark, sf)
    out = detection.pr_curve(found.where("excused = 0").select("image_id", "pred_idx", "score", F.col("hits").alias("hit")), truths, [])
    return out.select("image_id", "pred_idx", "score", "hit", F.col("tp").cast("long").alias("tp"), F.col("seen").cast("long").alias("seen"), r("precision").alias("precision"), r("recall").alias("recall"))


@query(f"WITH RECURSIVE {outcome_sql(ONE)}, {AP} SELECT threshold, round(ap, 6) AS ap FROM ap")
def map50(spark, sf):
    out = detection.average_precisions(*outcomes(spark, sf), (PARAMS.match_iou,))
    return out.select("threshold", r("ap").alias("ap"))


@query(f"WITH RECURSIVE {outcome_sql(THRESHOLDS)}, {AP} SELECT threshold, round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf):
    out = detection.average_precisions(*outcomes(spark, sf, COCO_THRESHOLDS), COCO_THRESHOLDS)
    return out.select("threshold", r("ap").alias("ap"))


@query(f"WITH RECURSIVE {outcome_sql(THRESHOLDS)}, {AP} SELECT round(avg(ap), 6) AS map50_95 FROM ap")
def map50_95(spark, sf):
    out = detection.average_precisions(*outcomes(spark, sf, COCO_THRESHOLDS), COCO_THRESHOLDS)
    return out.where(~F.isnan("ap")).agg(r(F.avg("ap")).alias("map50_95"))


_COUNTS = "count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'ignored') AS ignored"


@query(f"""WITH RECURSIVE {outcome_sql(ONE)}, c AS (SELECT 'inference' AS cut, {_COUNTS} FROM oc WHERE score >= 0.01 UNION ALL SELECT 'decision', {_COUNTS} FROM oc WHERE score >= 0.25),
 n AS (SELECT count(*) AS n_truths FROM kq) SELECT cut, tp, fp, ignored, n_truths, round(CASE WHEN n_truths > 0 THEN tp / n_truths ELSE 0 END, 6) AS detection_rate FROM c, n""")
def detection_counts(spark, sf):
    found, truths = outcomes(spark, sf)
    kinds = [F.sum(outcome(k)).alias(k) for k in ("tp", "fp", "ignored")]
    parts = [found.where(F.col("score") >= c).agg(*kinds).select(F.lit(n).alias("cut"), "*") for n, c in (("inference", PARAMS.inference_confidence), ("decision", PARAMS.report_confidence))]
    out = parts[0].unionByName(parts[1]).crossJoin(truths)
    return out.withColumn("detection_rate", r(F.coalesce(F.try_divide("tp", "n_truths"), F.lit(0.0))))


def crop_rows(spark, sf, margins=(PARAMS.margin,), perfect: bool = False) -> DataFrame:
    return images.crop_samples(shapes(spark, sf, predicted=not perfect), margins, perfect=perfect)


def _expanded(c: str, i: int) -> str:
    mid = f"((least({c}0, {c}1, {c}2, {c}3) + greatest({c}0, {c}1, {c}2, {c}3)) / 2)"
    return f"{mid} + ({c}{i} - {mid}) * (1 + 2 * margin) AS {c}{i}"


def crop_sql(margins: str, matches: str) -> str:
    k = "margin, image_id, truth_idx"
    v = ", ".join(XY)
    return f"""mg AS (SELECT unnest({margins}) AS margin), aq AS (SELECT image_id, ann_idx AS idx, {v} FROM tq),
 cr AS (SELECT margin, m.image_id, truth_idx, {', '.join(_expanded(c, i) for i in range(4) for c in 'xy')} FROM {matches} m CROSS JOIN mg),
 tg AS (SELECT margin, cr.image_id, truth_idx, {', '.join('kq.' + c for c in XY)} FROM cr JOIN kq ON cr.image_id = kq.image_id AND cr.truth_idx = kq.idx),
 c1 AS (SELECT margin, image_id, truth_idx, 0 AS idx, {v} FROM cr),
 c2 AS (SELECT margin, cr.image_id, truth_idx, aq.idx, {', '.join('aq.' + c for c in XY)} FROM cr JOIN aq ON cr.image_id = aq.image_id AND cr.truth_idx <> aq.idx),
 {covered_sql('tg', 'c1', k, 'cov')}, {covered_sql('cr', 'c2', k, 'con')},
 sc AS (SELECT image_id, CASE WHEN count(*) > 1 THEN 'fan' ELSE 'single' END AS scene FROM tq GROUP BY image_id),
 cs AS (SELECT mg.margin, kq.image_id, kq.idx AS truth_idx, cov.covered IS NOT NULL AS detected, CASE WHEN cov.covered IS NULL THEN 0 ELSE least(1, cov.covered / cov.area) END AS coverage, CASE WHEN con.covered IS NOT NULL THEN least(1, con.covered / con.area) END AS contamination, scene
   FROM kq CROSS JOIN mg JOIN sc ON sc.image_id = kq.image_id LEFT JOIN cov ON cov.margin = mg.margin AND cov.image_id = kq.image_id AND cov.truth_idx = kq.idx
   LEFT JOIN con ON con.margin = mg.margin AND con.image_id = kq.image_id AND con.truth_idx = kq.idx)"""


MATCHES = f"{TQ}, {KEPT}, {PQ}, {IOU}, {greedy_sql(ONE)}, mt AS (SELECT m.image_id, m.truth_idx, {', '.join('p.' + c for c in XY)} FROM matched m JOIN pq p ON m.image_id = p.image_id AND m.pred_idx = p.pred_idx)"
M1, M3 = "[0.05::DOUBLE]", "[0.0::DOUBLE, 0.05, 0.1]"
SUMMARY = """SELECT margin, count(*) AS n_truths, count(*) FILTER (WHERE detected) AS detected, round(quantile_cont(coverage, 0.05), 6) AS coverage_p5_all,
 round(coalesce(quantile_cont(coverage, 0.05) FILTER (WHERE detected), 0), 6) AS coverage_p5_detected, round(quantile_cont(coverage, 0.5), 6) AS coverage_median,
 round(coalesce(quantile_cont(contamination, 0.95), 0), 6) AS contamination_p95, round(coalesce(quantile_cont(contamination, 0.5), 0), 6) AS contamination_median,
 quantile_cont(coverage, 0.05) >= 0.98 AS meets_target FROM cs GROUP BY margin"""
SCENES = """SELECT margin, s.scene, count(contamination) AS n, round(coalesce(quantile_cont(contamination, 0.5), 0), 6) AS median, round(coalesce(quantile_cont(contamination, 0.95), 0), 6) AS p95,
 threshold, count(contamination) = 0 OR quantile_cont(contamination, 0.95) <= threshold AS passes FROM mg CROSS JOIN (VALUES ('single', 0.01::DOUBLE), ('fan', 0.92::DOUBLE)) s(scene, threshold)
 LEFT JOIN cs USING (margin, scene) GROUP BY margin, s.scene, threshold"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c) for c, t in df.dtypes if t == "double" and c not in ("margin", "threshold")})


@query(f"WITH RECURSIVE {MATCHES}, {crop_sql(M1, 'mt')} SELECT image_id, truth_idx, detected, round(coverage, 6) AS coverage, round(contamination, 6) AS contamination, scene FROM cs")
def crop_samples(spark, sf):
    return rounded(crop_rows(spark, sf)).drop("margin")


@query(f"WITH RECURSIVE {MATCHES}, {crop_sql(M1, 'mt')} {SUMMARY}")
def crop_summary(spark, sf):
    return rounded(crops.summary(crop_rows(spark, sf)))


@query(f"WITH RECURSIVE {MATCHES}, {crop_sql(M1, 'mt')} {SCENES}")
def contamination_by_scene(spark, sf):
    return rounded(crops.by_scene(crop_rows(spark, sf)))


@query(f"WITH RECURSIVE {MATCHES}, {crop_sql(M3, 'mt')} {SUMMARY}")
def margin_sweep(spark, sf):
    return rounded(crops.summary(crop_rows(spark, sf, PARAMS.margins)))


@query(f"""WITH {TQ}, {KEPT}, pf AS (SELECT image_id, idx AS truth_idx, {', '.join(XY)} FROM kq), {crop_sql(M1, 'pf')}
 SELECT scene, count(contamination) AS n, round(coalesce(quantile_cont(contamination, 0.95), 0), 6) AS p95 FROM (VALUES ('single'), ('fan')) s(scene) LEFT JOIN cs USING (scene) GROUP BY scene""")
def contamination_floor(spark, sf):
    """A perfect detector: predictions are the truths, each matched with itself."""
    return rounded(crops.by_scene(crop_rows(spark, sf, perfect=True))).select("scene", "n", "p95")


_GP, _GT = canonical_sql("pq", "image_id, pred_idx", "x", "y", "1.0", "gp"), canonical_sql("kq", "image_id, idx", "x", "y", "1.0", "gt")


@query(f"""WITH RECURSIVE {TQ}, {KEPT}, {PQ}, {IOU}, {greedy_sql(ONE)}, {_GP}, {_GT},
 gl AS (SELECT image_id, idx, max(len) AS longest FROM gt GROUP BY ALL),
 gv AS (SELECT m.image_id, m.pred_idx, gp.v, gp.x AS px, gp.y AS py, gt.x AS tx, gt.y AS ty, longest FROM matched m JOIN gp ON m.image_id = gp.image_id AND m.pred_idx = gp.pred_idx
   JOIN gt ON m.image_id = gt.image_id AND m.truth_idx = gt.idx AND gp.v = gt.v JOIN gl ON m.image_id = gl.image_id AND m.truth_idx = gl.idx),
 ga AS (SELECT image_id, pred_idx, degrees(atan2(max(py) FILTER (WHERE v = 1) - max(py) FILTER (WHERE v = 0), max(px) FILTER (WHERE v = 1) - max(px) FILTER (WHERE v = 0))) AS pa,
   degrees(atan2(max(ty) FILTER (WHERE v = 1) - max(ty) FILTER (WHERE v = 0), max(tx) FILTER (WHERE v = 1) - max(tx) FILTER (WHERE v = 0))) AS ta FROM gv GROUP BY ALL),
 gd AS (SELECT fmod(abs(fmod(pa + 180, 180) - fmod(ta + 180, 180)), 180) AS d FROM ga), ge AS (SELECT least(d, 180 - d) AS angle FROM gd), gx AS (SELECT sqrt((px - tx) ** 2 + (py - ty) ** 2) AS distance, longest FROM gv)
 SELECT * FROM (SELECT count(*) AS n_pairs, round(quantile_cont(angle, 0.5), 6) AS angle_median, round(quantile_cont(angle, 0.95), 6) AS angle_p95 FROM ge),
  (SELECT round(quantile_cont(distance, 0.5), 6) AS distance_median, round(quantile_cont(distance, 0.95), 6) AS distance_p95, round(quantile_cont(distance / longest, 0.5), 6) AS share_median, round(quantile_cont(distance / longest, 0.95), 6) AS share_p95 FROM gx)""")
def geometry_diagnostics(spark, sf):
    pairs = written(images.match_geometry(shapes(spark, sf)))
    distance = pairs.select("longest", F.explode(F.array("d0", "d1", "d2", "d3")).alias("distance"))
    return rounded(crops.geometry_summary(pairs, distance.withColumn("share", F.col("distance") / F.col("longest"))))


@query(f"""WITH RECURSIVE {outcome_sql(ONE)}, {AP}, mt AS (SELECT m.image_id, m.truth_idx, {', '.join('p.' + c for c in XY)} FROM matched m JOIN pq p ON m.image_id = p.image_id AND m.pred_idx = p.pred_idx), {crop_sql(M1, 'mt')}
 SELECT round(ap, 6) AS map50, (SELECT count(*) FROM fx_images) AS n_images, (SELECT count(*) FROM kq) AS n_truths, c.*, s.* FROM ap, (SELECT {_COUNTS} FROM oc) c,
  (SELECT round(quantile_cont(coverage, 0.05), 6) AS coverage_p5_all, round(quantile_cont(coverage, 0.5), 6) AS coverage_median, round(quantile_cont(contamination, 0.95), 6) AS contamination_p95 FROM cs) s""")
def evaluate_report(spark, sf):
    found, truths = outcomes(spark, sf)
    kinds = [F.sum(outcome(k)).alias(k) for k in ("tp", "fp", "ignored")]
    ap = detection.average_precisions(found, truths, (PARAMS.match_iou,)).select(r("ap").alias("map50"))
    n = fx(spark, sf, "fx_images").agg(F.count(F.lit(1)).alias("n_images"))
    s = rounded(crops.summary(crop_rows(spark, sf))).select("n_truths", "coverage_p5_all", "coverage_median", "contamination_p95")
    return ap.crossJoin(n).crossJoin(found.agg(*kinds)).crossJoin(s)


# Bootstrap. Draw j of a replicate falls into block md5(rep:j:seed) mod n div 4096, and the block's draw d on its image
# md5(rep:block:d:seed) mod size, so both engines draw the same.
B = PARAMS.bootstrap_samples
_HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
DRAWS = f"""un AS (SELECT image_id, row_number() OVER (ORDER BY md5(CAST(image_id AS VARCHAR)), image_id) - 1 AS place FROM (SELECT DISTINCT image_id FROM {{units}})), nn AS (SELECT count(*) AS n FROM un),
 bl AS (SELECT place // 4096 AS block, count(*) AS size FROM un GROUP BY 1),
 p1 AS (SELECT rep, j, {_HASH.format(f"rep || ':' || j || ':{PARAMS.seed}'")} % n // 4096 AS block FROM range({B}) a(rep), nn, LATERAL (SELECT unnest(range(n)) AS j)),
 p2 AS (SELECT rep, block, row_number() OVER (PARTITION BY rep, block ORDER BY j) - 1 AS d FROM p1),
 pk AS (SELECT rep, p2.block * 4096 + {_HASH.format(f"rep || ':' || p2.block || ':' || d || ':{PARAMS.seed}'")} % size AS place FROM p2 JOIN bl ON p2.block = bl.block),
 dr AS (SELECT rep, image_id, count(*) AS mult FROM pk JOIN un USING (place) GROUP BY rep, image_id)"""


@query(f"""WITH {DRAWS.format(units='fx_stats')}, v AS (SELECT image_id, avg(score) AS value FROM fx_stats GROUP BY image_id), s AS (SELECT rep, sum(mult * value) / sum(mult) AS value FROM dr JOIN v USING (image_id) GROUP BY rep)
 SELECT round((SELECT avg(value) FROM v), 6) AS value, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high, (SELECT n FROM nn) AS n, {B}::BIGINT AS samples FROM s""")
def bootstrap_ci(spark, sf):
    v = fx(spark, sf, "fx_stats").groupBy("image_id").agg(F.avg("score").alias("value"))
    n = v.count()
    return rounded(detection.interval(bootstrap.bootstrap_mean(v, B), "value", v.agg(F.avg("value").alias("value")), n, B))


@query(f"""WITH {DRAWS.format(units='fx_stats')}, al AS (SELECT rep, image_id, mult FROM dr UNION ALL SELECT -1, image_id, 1 FROM un),
 rw AS (SELECT rep, s.image_id, row_number() OVER (PARTITION BY rep, s.image_id ORDER BY score DESC, hit DESC) AS k, score, hit, mult FROM fx_stats s JOIN al USING (image_id)),
 pr AS (SELECT rep, sum(mult * hit) OVER w AS tp, sum(mult) OVER w AS seen, sum(mult * hit) OVER (PARTITION BY rep) AS n FROM rw WINDOW w AS (PARTITION BY rep ORDER BY score DESC, image_id, k ROWS UNBOUNDED PRECEDING)),
 cv AS (SELECT rep, tp / seen AS precision, tp / n AS recall FROM pr WHERE n > 0), rp AS (SELECT i, CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i * 0.01::DOUBLE END AS rec FROM range(101) x(i)),
 ap AS (SELECT rep, sum(coalesce(best, 0)) / 101 AS ap FROM (SELECT rep, i, max(precision) FILTER (WHERE recall >= rec) AS best FROM cv CROSS JOIN rp GROUP BY rep, i) GROUP BY rep)
 SELECT round((SELECT ap FROM ap WHERE rep = -1), 6) AS value, round(quantile_cont(ap, 0.025), 6) AS ci_low, round(quantile_cont(ap, 0.975), 6) AS ci_high, (SELECT n FROM nn) AS n, {B}::BIGINT AS samples FROM ap WHERE rep >= 0""")
def bootstrap_map50(spark, sf):
    """AP of each replicate by weights: an image drawn k times counts k times, nothing is copied."""
    from pyspark.sql import Window

    stats = fx(spark, sf, "fx_stats").withColumn("hit", F.col("hit").cast("int"))
    rows = written(stats.withColumn("pred_idx", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("hit")))))
    units = written(rows.groupBy("image_id").agg(F.sum("hit").alias("truths")))
    ap = written(bootstrap.bootstrap_ap(rows, units, B))
    return rounded(detection.interval(ap.where("rep >= 0"), "ap", ap.where("rep < 0").select(F.col("ap").alias("value")), units.count(), B))
