"""Queries over sparse images and the object catalog: components, matching, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import components as K
from lumenframe.operators import objects as O
from lumenframe.operators import report as M
from lumenframe.operators import sampling as S
from lumenframe.operators import tiles as T
from lumenframe.plans.pixel_queries import SCORES, SWEEP_TAIL
from lumenframe.plans.registry import query, rounded
from lumenframe.plans.scenes import CATALOG_SQL, SPARSE, SPARSE_SQL, STACK_SQL, catalog, order_key, order_sql, sparse, stack_pixels

THR, GAP, WIDTH, TILE = 0.5, 2, 3.0, 32
#: Pixels under each object, of all pixels of the image.
TRAIL_SQL = """gp AS (SELECT image_id, row_pos, r, c FROM (SELECT image_id, row_pos, x, y, beta, CAST(i AS INT) AS r, CAST(j AS INT) AS c, greatest(-trail_length/2, least(trail_length/2, (j-x)*cos(radians(beta)) + (i-y)*sin(radians(beta)))) AS t
 FROM cat JOIN range(128) a(i) ON i BETWEEN y-trail_length/2-3 AND y+trail_length/2+3 JOIN range(128) b(j) ON j BETWEEN x-trail_length/2-3 AND x+trail_length/2+3) WHERE (c-x - t*cos(radians(beta)))**2 + (r-y - t*sin(radians(beta)))**2 <= 2.250000001)"""


def labels_sql(gap: int, thr: float = THR) -> str:
    reach, grow = (2 * gap + 1, gap) if gap > 1 else (1, 0)
    return f"""{SPARSE_SQL}, sup AS (SELECT image_id, r, c, p, row_number() OVER (ORDER BY image_id, r, c) AS id FROM pxs WHERE p >= {thr}),
 e AS (SELECT a.id AS a, b.id AS b FROM sup a JOIN sup b ON a.image_id=b.image_id AND abs(a.r-b.r)<={reach} AND abs(a.c-b.c)<={reach} AND a.id<>b.id),
 reach(a, b) AS (SELECT id, id FROM sup UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
 root AS (SELECT b AS id, min(a) AS root FROM reach GROUP BY 1),
 fst AS (SELECT root, min(greatest(0, r-{grow})*1000 + greatest(0, c-{grow})) AS f FROM sup JOIN root USING (id) GROUP BY 1),
 lab AS (SELECT image_id, r, c, p, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY f) AS INT) AS label FROM sup JOIN root USING (id) JOIN fst USING (root))"""


WL = "WITH RECURSIVE " + labels_sql(GAP)


def support(spark, d, thr: float = THR):
    return sparse(spark, d).filter(F.col("p") >= thr)


def labelled(spark, d, gap: int = GAP):
    return K.label_components(support(spark, d), gap)


def matchable(spark, d):
    """Components of the images that have objects, which is where matching looks."""
    return K.label_components(O.of_objects(support(spark, d), catalog(spark, d)), GAP)


@query("a13_components", f"{WL} SELECT image_id, r, c, label FROM lab")
def a13(spark, d):
    return labelled(spark, d).select("image_id", "r", "c", "label")


@query("a13_components_gap1", f"WITH RECURSIVE {labels_sql(1)} SELECT image_id, r, c, label FROM lab")
def a13b(spark, d):
    return labelled(spark, d, 1).select("image_id", "r", "c", "label")


MEASURE = """ms AS (SELECT image_id, label, CAST(count(*) AS INT) AS area, avg(c) AS x, avg(r) AS y, max(p) AS peak_probability, avg(p) AS mean_probability,
 CAST(min(c) AS INT) AS bbox_x0, CAST(max(c)+1 AS INT) AS bbox_x1, CAST(min(r) AS INT) AS bbox_y0, CAST(max(r)+1 AS INT) AS bbox_y1 FROM lab GROUP BY 1,2),
 tk AS (SELECT image_id, label, avg(p) AS topk_mean_probability FROM (SELECT image_id, label, p, row_number() OVER (PARTITION BY image_id, label ORDER BY p DESC) AS k, count(*) OVER (PARTITION BY image_id, label) AS n FROM lab) WHERE k <= greatest(1, ceil(n*0.05)) GROUP BY 1,2)"""


@query("a11_measure", f"{WL}, {MEASURE} SELECT image_id, label, area, round(x,6) AS x, round(y,6) AS y, round(peak_probability,6) AS peak_probability, round(mean_probability,6) AS mean_probability, bbox_x0, bbox_x1, bbox_y0, bbox_y1, round(topk_mean_probability,6) AS topk_mean_probability, round(topk_mean_probability,6) AS score FROM ms JOIN tk USING (image_id, label)")
def a11(spark, d):
    return rounded(K.measure(labelled(spark, d)))


@query("a12_component_score", f"{WL} SELECT image_id, label, round(sum(p),6) AS score FROM lab GROUP BY 1,2")
def a12(spark, d):
    return rounded(K.measure(labelled(spark, d), "sum").select("image_id", "label", "score"))


@query("f09_accept", f"{WL}, {MEASURE} SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INT) AS label_id, area FROM ms JOIN tk USING (image_id, label) WHERE area BETWEEN 2 AND 40 AND topk_mean_probability >= 0.6 AND peak_probability >= 0.7")
def f09(spark, d):
    return K.accept(K.measure(labelled(spark, d)), 2, 40, 0.6, 0.7).select("image_id", "label", "label_id", "area")


@query("w08_image_numbers", f"WITH {CATALOG_SQL}, k AS (SELECT image_id AS panel, CASE WHEN image_id % 17 = 0 THEN 'test' ELSE 'train' END AS split, {order_sql('image_id')} AS o FROM cat GROUP BY 1) SELECT panel, split, row_number() OVER (PARTITION BY split ORDER BY o, panel) - 1 AS image_id FROM k")
def w08b(spark, d):
    k = images(spark, d).select(F.col("image_id").alias("panel"), F.when(F.col("image_id") % 17 == 0, "test").otherwise("train").alias("split"))
    return S.numbered(k, order_key("panel"), "panel", "image_id", by="split")


@query("w08_label_numbers", f"{WL}, {MEASURE} SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INT) AS label_id FROM ms WHERE area >= 2")
def w08(spark, d):
    return K.accept(K.measure(labelled(spark, d)), 2).select("image_id", "label", "label_id")


@query("t05_top_values", f"{WL} SELECT image_id, label, k, p FROM (SELECT image_id, label, round(p,6) AS p, CAST(row_number() OVER (PARTITION BY image_id, label ORDER BY p DESC) AS INT) AS k FROM lab) WHERE k <= 3")
def t05(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("image_id", "label").orderBy(F.desc("p")))
    return rounded(labelled(spark, d).select("image_id", "label", k.alias("k"), "p").filter("k <= 3"))


@query("u04_distinct_labels", f"{WL} SELECT DISTINCT image_id, label FROM lab")
def u04(spark, d):
    return labelled(spark, d).select("image_id", "label").distinct()


@query("g13_bounds", f"{WL} SELECT image_id, label, CAST(min(r) AS INT) AS y0, CAST(max(r)+1 AS INT) AS y1 FROM lab GROUP BY 1,2")
def g13(spark, d):
    return K.measure(labelled(spark, d)).select("image_id", "label", F.col("bbox_y0").alias("y0"), F.col("bbox_y1").alias("y1"))


@query("g14_detection_mask", f"{WL}, {MEASURE}, ok AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INT) AS label_id FROM ms WHERE area >= 3) SELECT image_id, r, c, label_id FROM lab JOIN ok USING (image_id, label)")
def g14(spark, d):
    lab = labelled(spark, d)
    return lab.join(K.accept(K.measure(lab), 3).select("image_id", "label", "label_id"), ["image_id", "label"]).select("image_id", "r", "c", "label_id")


@query("a38_paint", f"""{WL}, sc AS (SELECT image_id, label, max(p) AS s FROM lab GROUP BY 1,2), gr AS (SELECT DISTINCT image_id, label, r+dr AS r, c+dc AS c FROM lab, (SELECT unnest(range(-2,3)) AS dr), (SELECT unnest(range(-2,3)) AS dc))
 SELECT image_id, r, c, round(coalesce(s, p),6) AS p FROM pxs LEFT JOIN (SELECT image_id, r, c, s FROM gr JOIN sc USING (image_id, label)) USING (image_id, r, c)""")
def a38(spark, d):
    return rounded(K.paint(sparse(spark, d), THR, GAP).select("image_id", "r", "c", "p"))


COVERS = """(c-x - t*cos(radians(beta)))**2 + (r-y - t*sin(radians(beta)))**2 <= 2.250000001"""
EDGES = f"""ov AS (SELECT * FROM (SELECT cat.image_id, row_pos, label, r, c, x, y, beta, greatest(-trail_length/2, least(trail_length/2, (c-x)*cos(radians(beta)) + (r-y)*sin(radians(beta)))) AS t
 FROM cat JOIN lab ON cat.image_id=lab.image_id AND r BETWEEN y-trail_length/2-3 AND y+trail_length/2+3 AND c BETWEEN x-trail_length/2-3 AND x+trail_length/2+3) WHERE {COVERS}),
 ed AS (SELECT DISTINCT image_id, row_pos, label FROM ov)"""


#: Greedy matching: an object takes all components under it that no earlier one has, so the first object owns each.
GREEDY = f"""{EDGES}, own AS (SELECT image_id, label, min(row_pos) AS owner FROM ed GROUP BY 1,2),
 hits AS (SELECT image_id, count(*) AS m, count(*) FILTER (row_pos IN (SELECT owner FROM own)) AS tp FROM cat GROUP BY 1),
 parts AS (SELECT lab.image_id, lab.label, own.owner IS NOT NULL AS taken, bool_or(stk.image_id IS NOT NULL) AS masked FROM lab LEFT JOIN own ON own.image_id=lab.image_id AND own.label=lab.label
  LEFT JOIN stk ON stk.image_id=lab.image_id AND stk.r=lab.r AND stk.c=lab.c GROUP BY 1,2,3),
 pc AS (SELECT image_id, count(*) AS n, count(*) FILTER (NOT taken AND masked) AS skipped, count(*) FILTER (NOT taken AND NOT masked) AS free FROM parts GROUP BY 1),
 im AS (SELECT image_id, m, tp, coalesce(n,0) AS n, coalesce(skipped,0) AS skipped, coalesce(free,0) AS free FROM hits LEFT JOIN pc USING (image_id))"""
CONFUSION = "SELECT CAST(sum(tp) AS BIGINT) AS obj_tp, CAST(sum({}) AS BIGINT) AS obj_fp, CAST(sum(m-tp) AS BIGINT) AS obj_fn{} FROM im"
WG = f"{WL}, {CATALOG_SQL}, {STACK_SQL}, {GREEDY}"
TRUTH = f"""tr AS (SELECT DISTINCT image_id, r, c FROM (SELECT cat.image_id, r, c, x, y, beta, greatest(-trail_length/2, least(trail_length/2, (c-x)*cos(radians(beta)) + (r-y)*sin(radians(beta)))) AS t
 FROM cat JOIN pxs ON cat.image_id=pxs.image_id AND r BETWEEN y-trail_length/2-3 AND y+trail_length/2+3 AND c BETWEEN x-trail_length/2-3 AND x+trail_length/2+3) WHERE {COVERS})"""
#: Components of the baseline detector's mask.
MASK_PARTS = """ms1 AS (SELECT *, row_number() OVER (ORDER BY image_id, r, c) AS id FROM stk), me AS (SELECT a.id AS a, b.id AS b FROM ms1 a JOIN ms1 b ON a.image_id=b.image_id AND abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1 AND a.id<>b.id),
 mreach(a, b) AS (SELECT id, id FROM ms1 UNION SELECT mreach.a, me.b FROM mreach JOIN me ON mreach.b = me.a), mroot AS (SELECT b AS id, min(a) AS root FROM mreach GROUP BY 1), mfp AS (SELECT count(DISTINCT root) AS stack_fp FROM mroot)"""


def with_truth(spark, d):
    """The sparse images with gt: whether a pixel lies under an object."""
    truth = O.overlaps(catalog(spark, d), sparse(spark, d), WIDTH).select("image_id", "r", "c").distinct().withColumn("gt", F.lit(True))
    return sparse(spark, d).join(truth.hint("merge"), ["image_id", "r", "c"], "left").na.fill(False, ["gt"])


@query("j02_object_component_overlap", f"{WL}, {CATALOG_SQL}, {EDGES} SELECT * FROM ed")
def j02(spark, d):
    return O.edges(catalog(spark, d), labelled(spark, d), WIDTH)


PROBES = """cx AS (SELECT *, CASE WHEN row_pos % 4 > 0 THEN beta END AS b2 FROM cat), gr AS (SELECT DISTINCT image_id, r+dr AS r, c+dc AS c FROM pxs, (SELECT unnest(range(-2,3)) AS dr), (SELECT unnest(range(-2,3)) AS dc) WHERE p >= 0.5),
 ln AS (SELECT image_id, row_pos, greatest(0, least(127, CAST(round_even(round(x + trail_length*(i/(n-1) - 0.5)*cos(radians(b2)), 9), 0) AS INT))) AS c, greatest(0, least(127, CAST(round_even(round(y + trail_length*(i/(n-1) - 0.5)*sin(radians(b2)), 9), 0) AS INT))) AS r
  FROM (SELECT *, CAST(greatest(2, ceil(2*trail_length)) AS INT) AS n FROM cx WHERE b2 IS NOT NULL), range(130) t(i) WHERE i < n),
 dk AS (SELECT image_id, row_pos, x+b AS c, y+a AS r FROM cx, (SELECT unnest(range(-2,3)) AS a), (SELECT unnest(range(-2,3)) AS b) WHERE b2 IS NULL AND a*a+b*b <= 4),
 hit AS (SELECT DISTINCT row_pos FROM (SELECT * FROM ln UNION ALL SELECT * FROM dk) SEMI JOIN gr USING (image_id, r, c))"""


@query("j10_any_overlap", f"WITH {SPARSE_SQL}, {CATALOG_SQL}, {PROBES} SELECT row_pos, row_pos IN (SELECT row_pos FROM hit) AS nn_detected FROM cat")
def j10(spark, d):
    # A quarter of the objects has no direction, and is probed with a disk.
    cat = catalog(spark, d).withColumn("beta", F.when(F.col("row_pos") % 4 > 0, F.col("beta")))
    return O.any_overlap(cat, support(spark, d), GAP, SPARSE, SPARSE)


@query("j03_component_mask_overlap", f"{WL}, {STACK_SQL} SELECT DISTINCT image_id, label FROM lab JOIN stk USING (image_id, r, c)")
def j03(spark, d):
    return O.ignored(labelled(spark, d), stack_pixels(spark, d))


@query("j01_image_lookup", f"WITH {SPARSE_SQL}, {CATALOG_SQL} SELECT row_pos, count(p) AS n, round(max(p),6) AS top FROM cat LEFT JOIN pxs USING (image_id) GROUP BY 1")
def j01(spark, d):
    images = sparse(spark, d).groupBy("image_id").agg(F.count("p").alias("n"), F.max("p").alias("top"))
    return rounded(catalog(spark, d).join(images, "image_id", "left").select("row_pos", F.coalesce("n", F.lit(0)).alias("n"), "top"))


@query("g01_trail_pixels", f"WITH {CATALOG_SQL}, {TRAIL_SQL} SELECT row_pos, r, c FROM gp")
def g01(spark, d):
    return O.trail_pixels(catalog(spark, d), WIDTH, SPARSE, SPARSE).select("row_pos", "r", "c")


def _roi_sql(v: str, f: str, low: str, high: str) -> str:
    d = f"abs({f}(radians(beta)))*trail_length + 24"
    return f"CAST(greatest(0, least(128, floor(round({v} - ({d}), 9)))) AS INT) AS {low}, CAST(greatest(0, least(128, ceil(round({v} + ({d}), 9)) + 1)) AS INT) AS {high}"


@query("g05_trail_roi", f"WITH {CATALOG_SQL} SELECT row_pos, {_roi_sql('x', 'cos', 'x0', 'x1')}, {_roi_sql('y', 'sin', 'y0', 'y1')} FROM cat")
def g05(spark, d):
    return catalog(spark, d).select("row_pos", *O.roi(SPARSE, SPARSE, 40.0))


#: All thresholds at once: components are roots that spread over neighbours of at least the threshold.  All pixels of a cell
#: of edge 6 are neighbours, so cells take the place of pixels.
SCAN_SQL = f"""WITH RECURSIVE {SPARSE_SQL}, {CATALOG_SQL}, {STACK_SQL}, {TRUTH}, px8 AS (SELECT pxs.*, tr.image_id IS NOT NULL AS gt FROM pxs LEFT JOIN tr ON tr.image_id=pxs.image_id AND tr.r=pxs.r AND tr.c=pxs.c), {SWEEP_TAIL},
 ids AS (SELECT *, image_id*484 + (r//6)*22 + c//6 AS id FROM pxs SEMI JOIN cat USING (image_id)),
 cl AS (SELECT id, max(p) AS top FROM ids GROUP BY 1),
 e0 AS (SELECT a.id AS a, b.id AS b, max(least(a.p, b.p)) AS w FROM ids a JOIN ids b ON a.image_id=b.image_id AND abs(a.r-b.r)<=5 AND abs(a.c-b.c)<=5 AND a.id<>b.id GROUP BY 1,2),
 cc(thr_idx, thr, id, root) USING KEY (thr_idx, id) AS (SELECT thr_idx, thr, id, id FROM cl JOIN t ON top >= thr UNION
  SELECT cc.thr_idx, cc.thr, e0.b, min(cc.root) FROM cc JOIN e0 ON e0.a = cc.id AND e0.w >= cc.thr JOIN recurring.cc k ON k.thr_idx=cc.thr_idx AND k.id=e0.b WHERE cc.root < k.root GROUP BY 1,2,3),
 lb AS (SELECT thr_idx, image_id, root, r, c, p FROM cc JOIN ids USING (id) WHERE p >= thr),
 uo AS (SELECT * FROM (SELECT row_pos, id, p, r, c, x, y, beta, greatest(-trail_length/2, least(trail_length/2, (c-x)*cos(radians(beta)) + (r-y)*sin(radians(beta)))) AS t
  FROM cat JOIN ids ON cat.image_id=ids.image_id AND r BETWEEN y-trail_length/2-3 AND y+trail_length/2+3 AND c BETWEEN x-trail_length/2-3 AND x+trail_length/2+3) WHERE {COVERS}),
 le AS (SELECT DISTINCT thr_idx, row_pos, root FROM cc JOIN uo USING (id) WHERE p >= thr),
 ow AS (SELECT thr_idx, root, min(row_pos) AS owner FROM le GROUP BY 1,2),
 lp AS (SELECT lb.thr_idx, lb.image_id, lb.root, bool_or(ow.owner IS NOT NULL) AS taken, bool_or(stk.image_id IS NOT NULL) AS masked FROM lb LEFT JOIN ow ON ow.thr_idx=lb.thr_idx AND ow.root=lb.root
  LEFT JOIN stk ON stk.image_id=lb.image_id AND stk.r=lb.r AND stk.c=lb.c GROUP BY 1,2,3),
 lc AS (SELECT thr_idx, image_id, count(*) AS n, count(*) FILTER (NOT taken AND masked) AS skipped, count(*) FILTER (NOT taken AND NOT masked) AS free FROM lp GROUP BY 1,2),
 tq AS (SELECT thr_idx, image_id, count(*) AS tp FROM (SELECT DISTINCT thr_idx, owner FROM ow) JOIN cat ON row_pos=owner GROUP BY 1,2),
 oi AS (SELECT t.thr_idx, i.image_id, i.m, coalesce(tq.tp,0) AS tp, coalesce(lc.n,0) AS n, coalesce(lc.skipped,0) AS skipped, coalesce(lc.free,0) AS free FROM t CROSS JOIN (SELECT image_id, count(*) AS m FROM cat GROUP BY 1) i
  LEFT JOIN tq ON tq.thr_idx=t.thr_idx AND tq.image_id=i.image_id LEFT JOIN lc ON lc.thr_idx=t.thr_idx AND lc.image_id=i.image_id),
 ob AS (SELECT thr_idx, CAST(sum(tp) AS BIGINT) AS obj_tp, CAST(sum(greatest(n-tp-skipped,0)) AS BIGINT) AS obj_fp, CAST(sum(m-tp) AS BIGINT) AS obj_fn FROM oi GROUP BY 1),
 scan AS (SELECT *, {SCORES.format('pix_tp', 'pix_fp', 'pix_fn', 'pix_')}, {SCORES.format('obj_tp', 'obj_fp', 'obj_fn', 'obj_')} FROM sw JOIN ob USING (thr_idx))"""

HISTOGRAM_SQL = """SELECT 'histogram_{0}', n.name, bin, 0, n.v FROM (SELECT bin, [{{'name': 'n', 'v': count(*)}}, {{'name': 'nn', 'v': count(*) FILTER (a)}}, {{'name': 'stack', 'v': count(*) FILTER (s)}}, {{'name': 'either', 'v': count(*) FILTER (a OR s)}},
 {{'name': 'nn_only', 'v': count(*) FILTER (a AND NOT s)}}, {{'name': 'completeness', 'v': count(*) FILTER (a OR s)/count(*)}}] AS ns FROM (SELECT CAST(least(floor(({0}-lo)/((hi-lo)/12)), 11) AS INT) AS bin, nn AS a, stack_detection AS s FROM mc, (SELECT min({0}) AS lo, max({0}) AS hi FROM mc)) GROUP BY 1), unnest(ns) u(n)"""
COMPLETENESS_SQL = """SELECT '{0}', n.name, bin_x, bin_y, n.v FROM (SELECT i AS bin_x, j AS bin_y, [{{'name': 'total', 'v': count(z.f)}}, {{'name': 'detected', 'v': count(*) FILTER (z.f)}}, {{'name': 'ratio', 'v': coalesce(count(*) FILTER (z.f)/nullif(count(z.f),0),0)}}] AS ns
 FROM range(10) x(i) CROSS JOIN range(10) y(j) LEFT JOIN (SELECT CAST(least(floor((SNR-lx)/((hx-lx)/10)),9) AS INT) AS a, CAST(least(floor((trail_length-ly)/((hy-ly)/10)),9) AS INT) AS b, {1} AS f FROM mc, (SELECT min(SNR) AS lx, max(SNR) AS hx, min(trail_length) AS ly, max(trail_length) AS hy FROM mc)) z ON z.a=i AND z.b=j GROUP BY 1,2), unnest(ns) u(n)"""
REPORT_SQL = f"""{SCAN_SQL}, {MASK_PARTS}, best AS (SELECT thr_idx, thr, obj_f2 FROM scan ORDER BY obj_f2 DESC, thr_idx LIMIT 1),
 mc AS (SELECT cat.*, row_pos IN (SELECT row_pos FROM le SEMI JOIN best USING (thr_idx)) AS nn, row_pos IN (SELECT owner FROM ow SEMI JOIN best USING (thr_idx)) AS hit FROM cat),
 pts AS (SELECT thr_idx, coalesce(pix_fp/nullif(pix_fp+pix_tn,0),0) AS fpr, coalesce(pix_tp/nullif(pix_tp+pix_fn,0),0) AS tpr FROM scan), roc AS (SELECT *, CAST(row_number() OVER (ORDER BY fpr, thr_idx) AS INT) AS pos FROM pts),
 fr AS (SELECT thr_idx, obj_fp/50.0 AS fppi, coalesce(obj_tp/nullif(obj_tp+obj_fn,0),0) AS recall FROM scan), fm AS (SELECT *, max(recall) OVER (ORDER BY fppi, thr_idx ROWS UNBOUNDED PRECEDING) AS recall_plot FROM fr),
 bo AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(free) AS BIGINT) AS fp, CAST(sum(m-tp) AS BIGINT) AS fn FROM oi SEMI JOIN best USING (thr_idx)),
 bp AS (SELECT count(*) FILTER (p>=thr AND gt) AS tp, count(*) FILTER (p>=thr AND NOT gt) AS fp, count(*) FILTER (p<thr AND gt) AS fn, count(*) FILTER (p<thr AND NOT gt) AS tn FROM px8, best),
 rows(section, name, i, j, value) AS (SELECT 'sweep', name, thr_idx, 0, value FROM (UNPIVOT (SELECT thr_idx, CAST(COLUMNS(* EXCLUDE (thr_idx)) AS DOUBLE) FROM scan) ON COLUMNS(* EXCLUDE (thr_idx)) INTO NAME name VALUE value)
 UNION ALL SELECT 'roc', 'fpr', pos, 0, fpr FROM roc UNION ALL SELECT 'roc', 'tpr', pos, 0, tpr FROM roc
 UNION ALL SELECT 'area', 'roc', 0, 0, sum(v) FROM (SELECT (fpr-lag(fpr) OVER (ORDER BY pos))*(tpr+lag(tpr) OVER (ORDER BY pos))/2 AS v FROM roc)
 UNION ALL SELECT 'froc', 'fppi', thr_idx, 0, fppi FROM fm UNION ALL SELECT 'froc', 'recall', thr_idx, 0, recall FROM fm UNION ALL SELECT 'froc', 'recall_plot', thr_idx, 0, recall_plot FROM fm
 UNION ALL SELECT 'best', 'thr', 0, 0, thr FROM best UNION ALL SELECT 'best', 'obj_f2', 0, 0, obj_f2 FROM best
 UNION ALL SELECT 'confusion', 'obj_tp', 0, 0, tp FROM bo UNION ALL SELECT 'confusion', 'obj_fp', 0, 0, fp FROM bo UNION ALL SELECT 'confusion', 'obj_fn', 0, 0, fn FROM bo
 UNION ALL SELECT 'confusion', 'pix_tp', 0, 0, tp FROM bp UNION ALL SELECT 'confusion', 'pix_fp', 0, 0, fp FROM bp UNION ALL SELECT 'confusion', 'pix_fn', 0, 0, fn FROM bp UNION ALL SELECT 'confusion', 'pix_tn', 0, 0, tn FROM bp
 UNION ALL SELECT 'combined', 'tp', 0, 0, count(*) FILTER (nn OR stack_detection) FROM mc UNION ALL SELECT 'combined', 'fn', 0, 0, count(*) FILTER (NOT (nn OR stack_detection)) FROM mc UNION ALL SELECT 'combined', 'fp', 0, 0, bo.fp + stack_fp FROM bo, mfp
 UNION ALL {HISTOGRAM_SQL.format('SNR')} UNION ALL {HISTOGRAM_SQL.format('trail_length')}
 UNION ALL {COMPLETENESS_SQL.format('completeness', 'nn')} UNION ALL {COMPLETENESS_SQL.format('completeness_nn_only', 'nn AND NOT stack_detection')})
 SELECT section, name, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(CAST(value AS DOUBLE), 6) AS value FROM rows"""


@query("a02_object_confusion", f"{WG} {CONFUSION.format('greatest(n-tp,0)', '')}")
def a02(spark, d):
    return O.confusion(catalog(spark, d), matchable(spark, d), WIDTH)


@query("a02_object_confusion_mask", f"{WG} {CONFUSION.format('free', '')}")
def a02b(spark, d):
    return O.confusion(catalog(spark, d), matchable(spark, d), WIDTH, stack_pixels(spark, d))


@query("a03_object_confusion_sweep_rule", f"{WG} {CONFUSION.format('greatest(n-tp-skipped,0)', '')}")
def a03(spark, d):
    return O.confusion(catalog(spark, d), matchable(spark, d), WIDTH, stack_pixels(spark, d), per_threshold=True)


@query("a04_object_sweep", f"{SCAN_SQL} SELECT * FROM scan")
def a04(spark, d):
    return rounded(O.threshold_scan(catalog(spark, d), with_truth(spark, d), WIDTH, GAP, stack_px=stack_pixels(spark, d)))


@query("a19_full_confusion", f"{WG}, {TRUTH}, px AS (SELECT p >= {THR} AS hit, tr.image_id IS NOT NULL AS gt FROM pxs LEFT JOIN tr ON tr.image_id=pxs.image_id AND tr.r=pxs.r AND tr.c=pxs.c), pq AS (SELECT count(*) FILTER (hit AND gt) AS pix_tp, count(*) FILTER (hit AND NOT gt) AS pix_fp, count(*) FILTER (NOT hit AND gt) AS pix_fn, count(*) FILTER (NOT hit AND NOT gt) AS pix_tn FROM px) SELECT * FROM ({CONFUSION.format('greatest(n-tp,0)', '')}), pq")
def a19(spark, d):
    return O.covered_confusion(catalog(spark, d), sparse(spark, d), WIDTH, GAP, THR)


@query("m07_metric_report", REPORT_SQL)
def m07(spark, d):
    return rounded(M.metric_report(catalog(spark, d), with_truth(spark, d), WIDTH, GAP, stack_pixels(spark, d), 50))


@query("a17_stack_metrics", f"{WL}, {CATALOG_SQL} SELECT count(*) FILTER (stack_detection) AS tp, (SELECT CAST(sum(m) AS BIGINT) FROM (SELECT max(label) AS m FROM lab GROUP BY image_id)) AS fp, count(*) FILTER (NOT stack_detection) AS fn, CAST(NULL AS BIGINT) AS tn FROM cat")
def a17(spark, d):
    return O.stack_metrics(catalog(spark, d), labelled(spark, d))


@query("a18_combined_confusion", f"{WG}, {MASK_PARTS}, fl AS (SELECT row_pos IN (SELECT row_pos FROM ed) OR stack_detection AS found FROM cat) SELECT count(*) FILTER (found) AS tp, count(*) FILTER (NOT found) AS fn, (SELECT CAST(sum(free) AS BIGINT) FROM im) + (SELECT stack_fp FROM mfp) AS fp FROM fl")
def a18(spark, d):
    return O.combined(catalog(spark, d), matchable(spark, d), WIDTH, stack_pixels(spark, d))


@query("a14_catalog_groups", f"WITH {CATALOG_SQL} SELECT image_id, count(*) AS n, CAST(min(row_pos) AS BIGINT) AS first_pos, list(x ORDER BY row_pos) AS xs FROM cat GROUP BY 1")
def a14(spark, d):
    g = catalog(spark, d).groupBy("image_id").agg(F.count("*").alias("n"), F.min("row_pos").alias("first_pos"), F.array_sort(F.collect_list(F.struct("row_pos", "x"))).alias("g"))
    return g.select("image_id", "n", "first_pos", F.col("g.x").alias("xs"))


IMAGES = "(SELECT DISTINCT image_id FROM cat)"


def images(spark, d):
    return catalog(spark, d).select("image_id").distinct()


@query("s02_tiles", f"WITH {CATALOG_SQL} SELECT image_id, CAST(a AS INT) AS tr, CAST(b AS INT) AS tc, CAST(a*4+b AS INT) AS tile_index FROM {IMAGES}, range(4) t(a), range(4) u(b)")
def s02(spark, d):
    return T.enumerate_tiles(images(spark, d), SPARSE, SPARSE, TILE)


LOW = "floor(least(127, greatest(0, floor({}))) / 32)"
TOUCH = f"""tch AS (SELECT image_id, row_pos, CAST(a AS INT) AS tr, CAST(b AS INT) AS tc, stack_detection FROM cat, range(4) t(a), range(4) u(b)
 WHERE a BETWEEN {LOW.format('y-trail_length/2-4')} AND {LOW.format('y+trail_length/2+4')} AND b BETWEEN {LOW.format('x-trail_length/2-4')} AND {LOW.format('x+trail_length/2+4')})"""


@query("j06_object_tile_join", f"WITH {CATALOG_SQL}, {TOUCH} SELECT image_id, row_pos, tr, tc FROM tch")
def j06(spark, d):
    return T.touched(catalog(spark, d), SPARSE, SPARSE, TILE, 4.0)


@query("u03_distinct_tiles", f"WITH {CATALOG_SQL}, {TOUCH} SELECT DISTINCT image_id, tr, tc FROM tch")
def u03(spark, d):
    return T.touched(catalog(spark, d), SPARSE, SPARSE, TILE, 4.0).select("image_id", "tr", "tc").distinct()


@query("d01_tile_buckets", f"""WITH {CATALOG_SQL}, {TOUCH}, m AS (SELECT image_id, tr, tc, bool_or(NOT stack_detection) AS missed, bool_or(stack_detection) AS detected FROM tch GROUP BY 1,2,3)
, g AS (SELECT image_id, CAST(a AS INT) AS tr, CAST(b AS INT) AS tc FROM {IMAGES}, range(4) t(a), range(4) u(b))
 SELECT image_id, tr, tc, CASE WHEN missed THEN 'missed' WHEN detected THEN 'detected' ELSE 'background' END AS bucket FROM g LEFT JOIN m USING (image_id, tr, tc)""")
def d01(spark, d):
    tiles = T.enumerate_tiles(images(spark, d), SPARSE, SPARSE, TILE)
    return T.tile_flags(tiles, catalog(spark, d), SPARSE, SPARSE, TILE, 4.0).select("image_id", "tr", "tc", "bucket")


@query("f04_tiles_of_panels", f"WITH {CATALOG_SQL}, ids AS (SELECT image_id FROM cat GROUP BY 1 HAVING bool_or(nn_detected AND stack_detection)) SELECT image_id, CAST(a AS INT) AS tr, CAST(b AS INT) AS tc FROM {IMAGES} SEMI JOIN ids USING (image_id), range(4) t(a), range(4) u(b)")
def f04(spark, d):
    ids = catalog(spark, d).groupBy("image_id").agg(F.bool_or(F.col("nn_detected") & F.col("stack_detection")).alias("k")).filter("k").select("image_id")
    return T.enumerate_tiles(images(spark, d), SPARSE, SPARSE, TILE).join(ids, "image_id", "left_semi").select("image_id", "tr", "tc")


@query("g07_tile_arrays", f"WITH {SPARSE_SQL} SELECT image_id, CAST(r//32 AS INT) AS tr, CAST(c//32 AS INT) AS tc, round(sum(p),4) AS total, CAST(1024 AS INT) AS n FROM pxs GROUP BY 1,2,3")
def g07(spark, d):
    t = T.tile_arrays(sparse(spark, d), TILE)
    return t.select("image_id", "tr", "tc", F.round(F.aggregate("data", F.lit(0.0), lambda a, b: a + b), 4).alias("total"), F.size("data").alias("n"))


@query("g08_reassemble", """WITH px AS (SELECT vec_id AS image_id, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings) SELECT image_id, CAST(pos//8 AS INT) AS r, CAST(pos%8 AS INT) AS c, round(CAST(v AS DOUBLE),6) AS p FROM px""")
def g08(spark, d):
    from lumenframe.plans.scenes import DENSE, dense

    px = dense(spark, d).select("image_id", "r", "c", F.col("flux").alias("p"))
    return rounded(T.reassemble(T.tile_arrays(px, 3), DENSE, DENSE, 3))


@query("s09_side_scan", f"WITH {SPARSE_SQL}, {STACK_SQL}, {CATALOG_SQL}, sd AS (SELECT DISTINCT image_id, r, c FROM stk WHERE image_id % 10 > 0) SELECT i.image_id, CAST(a AS INT) AS tr, CAST(b AS INT) AS tc, 1024 AS n, coalesce(k.total, 0) AS total FROM {IMAGES} i, range(4) t(a), range(4) u(b) LEFT JOIN (SELECT image_id, r//32 AS tr, c//32 AS tc, count(*) AS total FROM sd GROUP BY 1,2,3) k ON k.image_id=i.image_id AND k.tr=a AND k.tc=b")
def s09(spark, d):
    # Every tenth image has no side array; its tiles are zeros.
    side = stack_pixels(spark, d).filter("image_id % 10 > 0").distinct().withColumn("real", F.lit(1.0))
    tiles = T.side_tiles(T.enumerate_tiles(images(spark, d), SPARSE, SPARSE, TILE), side, TILE, "real")
    return tiles.select("image_id", "tr", "tc", F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, b: a + b).cast("long").alias("total"))


@query("j08_flat_tile_index", f"WITH {SPARSE_SQL} SELECT image_id*16 + (r//32)*4 + c//32 AS tile, count(*) AS n FROM pxs GROUP BY 1")
def j08(spark, d):
    tile = F.col("image_id") * 16 + F.floor(F.col("r") / 32) * 4 + F.floor(F.col("c") / 32)
    return sparse(spark, d).groupBy(tile.alias("tile")).agg(F.count("*").alias("n"))


@query("u02_union_of_pixels", f"WITH {SPARSE_SQL}, {STACK_SQL} SELECT image_id, r, c FROM stk UNION SELECT image_id, r, c FROM pxs WHERE p >= 0.9")
def u02(spark, d):
    return stack_pixels(spark, d).unionByName(sparse(spark, d).filter("p >= 0.9").select("image_id", "r", "c")).distinct()


@query("u06_set_difference", f"{WL}, {STACK_SQL} SELECT DISTINCT image_id, label FROM lab EXCEPT SELECT DISTINCT image_id, label FROM lab JOIN stk USING (image_id, r, c)")
def u06(spark, d):
    lab = labelled(spark, d)
    return lab.select("image_id", "label").distinct().join(O.ignored(lab, stack_pixels(spark, d)), ["image_id", "label"], "left_anti")
