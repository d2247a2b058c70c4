"""Queries over the dense images: metrics, sweeps, curves, statistics and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import curves as C
from lumenframe.operators import pixels as P
from lumenframe.plans.registry import query, rounded
from lumenframe.plans.scenes import DENSE, DENSE_SQL, dense, order_key, order_sql

W = "WITH " + DENSE_SQL
SCORES = """coalesce(round({0}/nullif({0}+{1},0),6),0) AS {3}precision, coalesce(round({0}/nullif({0}+{2},0),6),0) AS {3}recall,
 coalesce(round(2.0*{0}/nullif(2*{0}+{2}+{1},0),6),0) AS {3}f1, coalesce(round(5.0*{0}/nullif(5*{0}+4*{2}+{1},0),6),0) AS {3}f2"""

SWEEP_TAIL = """h AS (SELECT CAST(floor(greatest(0.0, least(1.0, p))*4095) AS INT) AS bin, count(*) FILTER (gt) AS pos, count(*) FILTER (NOT gt) AS neg FROM px8 GROUP BY 1),
t AS (SELECT CAST(i AS INT) AS thr_idx, round(i/50.0, 9) AS thr, CAST(floor(round(i/50.0, 9)*4095) AS INT) AS tbin FROM range(51) x(i)),
s AS (SELECT thr_idx, thr, CAST(coalesce(sum(pos),0) AS BIGINT) AS pix_tp, CAST(coalesce(sum(neg),0) AS BIGINT) AS pix_fp FROM t LEFT JOIN h ON bin >= tbin GROUP BY ALL),
sw AS (SELECT thr_idx, thr, pix_tp, pix_fp, CAST((SELECT sum(pos) FROM h) AS BIGINT) - pix_tp AS pix_fn, CAST((SELECT sum(neg) FROM h) AS BIGINT) - pix_fp AS pix_tn FROM s)"""
SWEEP_CTE = f"{DENSE_SQL}, {SWEEP_TAIL}"


@query("a05_pixel_sweep", f"WITH {SWEEP_CTE} SELECT *, {SCORES.format('pix_tp', 'pix_fp', 'pix_fn', 'pix_')} FROM sw")
def a05(spark, d):
    return rounded(P.sweep(dense(spark, d)))


@query("a01_pixel_confusion", f"{W} SELECT count(*) FILTER (p>=0.6 AND gt) AS tp, count(*) FILTER (p>=0.6 AND NOT gt) AS fp, count(*) FILTER (p<0.6 AND gt) AS fn, count(*) FILTER (p<0.6 AND NOT gt) AS tn FROM px8")
def a01(spark, d):
    return P.confusion(dense(spark, d), 0.6)


@query("f01_binarise", f"{W} SELECT image_id, r, c FROM px8 WHERE p >= 0.75")
def f01(spark, d):
    return dense(spark, d).filter("p >= 0.75").select("image_id", "r", "c")


@query("f05_panels_with_positives", f"{W} SELECT image_id FROM px8 GROUP BY image_id HAVING bool_or(gt AND p > 0.8)")
def f05(spark, d):
    return dense(spark, d).groupBy("image_id").agg(F.bool_or(F.col("gt") & (F.col("p") > 0.8)).alias("any")).filter("any").select("image_id")


@query("f05_some_panels", f"{W}, o AS (SELECT image_id FROM px8 GROUP BY 1 ORDER BY {order_sql('image_id')}, image_id LIMIT 120) SELECT image_id FROM px8 SEMI JOIN o USING (image_id) GROUP BY image_id HAVING bool_or(gt AND p > 0.8)")
def f05b(spark, d):
    return P.panels_with_positives(dense(spark, d), F.col("gt") & (F.col("p") > 0.8), 120, order_key("image_id"))


@query("f07_valid_pixels", f"{W} SELECT image_id, count(*) AS n FROM px8 WHERE NOT real > 0.5 GROUP BY 1")
def f07(spark, d):
    return P.valid(dense(spark, d)).groupBy("image_id").agg(F.count("*").alias("n"))


def auc_sql(guard: str, anchors: str, empty: str, where: str = "NOT real > 0.5") -> str:
    return f"""{W}, h AS (SELECT greatest(0, least(255, CAST(floor(p*256) AS INT))) AS bin, count(*) FILTER (gt) AS pos, count(*) FILTER (NOT gt) AS neg FROM px8 WHERE {where} GROUP BY 1),
    k AS (SELECT -bin AS o, sum(neg) OVER w/(sum(neg) OVER () {guard}) AS x, sum(pos) OVER w/(sum(pos) OVER () {guard}) AS y FROM h WINDOW w AS (ORDER BY bin DESC)),
    a AS (SELECT * FROM k {anchors}), d AS (SELECT (x - lag(x) OVER (ORDER BY o))*(y + lag(y) OVER (ORDER BY o))/2 AS v FROM a)
    SELECT round(CASE WHEN (SELECT count(*) FROM h WHERE pos>0)=0 OR (SELECT count(*) FROM h WHERE neg>0)=0 THEN {empty} ELSE sum(v) END, 6) AS auc FROM d"""


@query("a06_auc_half", auc_sql("", "", "0.5"))
def a06(spark, d):
    return rounded(P.histogram_auc(P.valid(dense(spark, d)), empty=0.5))


@query("a07_auc_agg", auc_sql("", "", "NULL"))
def a07(spark, d):
    return rounded(P.histogram_auc(P.valid(dense(spark, d))))


@query("a08_auc_anchored", auc_sql("+ 1e-12", "UNION ALL SELECT -999, 0.0, 0.0 UNION ALL SELECT 999, 1.0, 1.0", "NULL"))
def a08(spark, d):
    return rounded(P.histogram_auc(P.valid(dense(spark, d)), anchored=True))


@query("a24_polarity_auc", f"SELECT 'kept' AS mask, auc FROM ({auc_sql('+ 1e-12', 'UNION ALL SELECT -999, 0.0, 0.0 UNION ALL SELECT 999, 1.0, 1.0', 'NULL')}) UNION ALL SELECT 'inverted', auc FROM ({auc_sql('+ 1e-12', 'UNION ALL SELECT -999, 0.0, 0.0 UNION ALL SELECT 999, 1.0, 1.0', 'NULL', 'real > 0.5')})")
def a24(spark, d):
    px = dense(spark, d)
    tag = lambda m, f: rounded(P.histogram_auc(f, anchored=True)).select(F.lit(m).alias("mask"), "auc")
    return tag("kept", P.valid(px)).unionByName(tag("inverted", px.filter("real > 0.5")))


@query("a20_mask_counts", f"{W} SELECT count(*) FILTER (gt AND real=0) AS pos_valid, count(*) FILTER (NOT gt AND real=0) AS neg_valid, count(*) FILTER (gt) AS pos_all, count(*) FILTER (NOT gt) AS neg_all FROM px8")
def a20(spark, d):
    return P.mask_counts(dense(spark, d))


@query("a21_mask_similarity", f"{W} SELECT round(avg(CAST((gt = (real=1)) AS INT)),6) AS equal_rate, round(count(*) FILTER (gt AND real=1)/count(*) FILTER (gt OR real=1),6) AS iou, round(corr(CAST(gt AS INT), real),6) AS pearson, count(*) FILTER (gt) AS sum_y, count(*) FILTER (real=1) AS sum_real FROM px8")
def a21(spark, d):
    return rounded(P.similarity(dense(spark, d)))


STATS = "m AS (SELECT image_id, median(flux) AS med FROM px8 GROUP BY 1), st AS (SELECT image_id, med, 1.4826*(median(abs(flux-med)) + 1e-12) AS sigma FROM px8 JOIN m USING (image_id) GROUP BY 1, 2)"


@query("a09_robust_stats", f"{W}, {STATS} SELECT image_id, round(med,6) AS med, round(sigma,6) AS sigma FROM st")
def a09(spark, d):
    return rounded(P.robust_stats(dense(spark, d)))


@query("a10_crop_stats", f"{W}, px6 AS (SELECT * FROM px8 WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6), {STATS.replace('px8', 'px6')} SELECT image_id, round(med,6) AS med, round(sigma,6) AS sigma FROM st")
def a10(spark, d):
    return rounded(P.robust_stats(P.centre_crop(dense(spark, d), DENSE, DENSE, 6)))


@query("x16_zscore_clip", f"{W}, {STATS} SELECT image_id, r, c, round(greatest(-1.5, least(1.5, (flux-med)/sigma)),6) AS z FROM px8 JOIN st USING (image_id)")
def x16(spark, d):
    px = dense(spark, d)
    return rounded(P.normalise(px, P.robust_stats(px), clip=1.5).select("image_id", "r", "c", "z"))


@query("x17_lower_median_norm", f"{W}, rm AS (SELECT image_id, r, quantile_disc(flux,0.5) AS m FROM px8 GROUP BY 1,2), md AS (SELECT image_id, quantile_disc(m,0.5) AS med FROM rm GROUP BY 1), sg AS (SELECT quantile_disc(abs(flux-med),0.5)*1.4826+1e-6 AS sigma FROM px8 JOIN md USING (image_id)) SELECT image_id, round(med,6) AS med, round(sigma,6) AS sigma FROM md, sg")
def x17(spark, d):
    return rounded(P.row_median_stats(dense(spark, d)))


@query("x18_sigmoid", f"{W} SELECT image_id, r, c, round(1/(1+exp(-flux)),6) AS s FROM px8")
def x18(spark, d):
    return rounded(dense(spark, d).select("image_id", "r", "c", (1 / (1 + F.exp(-F.col("flux")))).alias("s")))


@query("a22_dataset_fractions", f"{W}, b AS (SELECT image_id, avg(CAST(gt AS INT)) AS f FROM px8 GROUP BY 1) SELECT round(avg(f),6) AS mean, round(quantile_cont(f,0.5),6) AS p50, round(quantile_cont(f,0.9),6) AS p90, round(quantile_cont(f,0.99),6) AS p99 FROM b")
def a22(spark, d):
    b = dense(spark, d).groupBy("image_id").agg(F.avg(F.col("gt").cast("double")).alias("f"))
    q = F.percentile("f", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return rounded(b.agg(F.avg("f").alias("mean"), q.alias("q")).select("mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))]))


PROBE = f"""{W}, h AS (SELECT image_id % 16 AS batch, greatest(0, least(255, CAST(floor(p*256) AS INT))) AS bin, count(*) FILTER (gt) AS pos, count(*) FILTER (NOT gt) AS neg FROM px8 WHERE NOT real > 0.5 AND (image_id % 16 > 1 OR gt = (image_id % 16 = 0)) GROUP BY 1, 2),
 k AS (SELECT batch, bin, sum(neg) OVER w AS fp, sum(pos) OVER w AS tp, sum(neg) OVER (PARTITION BY batch) AS nn, sum(pos) OVER (PARTITION BY batch) AS np FROM h WINDOW w AS (PARTITION BY batch ORDER BY bin DESC)),
 z AS (SELECT batch, nn, np, (fp/nullif(nn,0) - lag(fp/nullif(nn,0)) OVER u)*(tp/nullif(np,0) + lag(tp/nullif(np,0)) OVER u)/2 AS v FROM k WINDOW u AS (PARTITION BY batch ORDER BY bin DESC)),
 b AS (SELECT batch, CASE WHEN min(nn) > 0 AND min(np) > 0 THEN sum(v) END AS auc FROM z GROUP BY 1)
 SELECT round(avg(auc),6) AS mean, round(stddev_pop(auc),6) AS std, round(min(auc),6) AS lo, round(max(auc),6) AS hi, count(*) FILTER (auc < 0.5) AS bad, count(*) FILTER (auc IS NULL) AS missing FROM b"""


@query("a23_validation_probe", PROBE)
def a23(spark, d):
    # Two batches lack a class, so that their area is missing.
    batch = F.col("image_id") % 16
    px = P.valid(dense(spark, d)).withColumn("batch", batch).filter((batch > 1) | (F.col("gt") == (batch == 0)))
    b = P.histogram_auc_by(px, "batch")
    return rounded(b.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.min("auc").alias("lo"), F.max("auc").alias("hi"), P.count_if(F.col("auc") < 0.5).alias("bad"), P.count_if(F.col("auc").isNull()).alias("missing")))


@query("w01_reverse_cumulative", f"WITH {SWEEP_CTE} SELECT bin, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM h WINDOW w AS (ORDER BY bin DESC)")
def w01(spark, d):
    return P.from_top(P.histogram(dense(spark, d), P.sweep_bin(4096))).select("bin", "tp", "fp")


ROC_CTE = SWEEP_CTE + ", pts AS (SELECT thr_idx AS order_idx, coalesce(pix_fp/nullif(pix_fp+pix_tn,0),0) AS fpr, coalesce(pix_tp/nullif(pix_tp+pix_fn,0),0) AS tpr FROM sw), roc AS (SELECT *, CAST(row_number() OVER (ORDER BY fpr, order_idx) AS INT) AS pos FROM pts)"


@query("w04_roc", f"WITH {ROC_CTE} SELECT order_idx, round(fpr,6) AS fpr, round(tpr,6) AS tpr, pos FROM roc")
def w04(spark, d):
    return rounded(C.roc(P.sweep(dense(spark, d))))


@query("w05_froc", f"WITH {SWEEP_CTE}, f AS (SELECT thr_idx, thr, pix_fp/50.0 AS fppi, coalesce(pix_tp/nullif(pix_tp+pix_fn,0),0) AS recall FROM sw) SELECT thr_idx, thr, round(fppi,6) AS fppi, round(recall,6) AS recall, round(max(recall) OVER (ORDER BY fppi, thr_idx ROWS UNBOUNDED PRECEDING),6) AS recall_plot FROM f")
def w05(spark, d):
    return rounded(C.froc(P.sweep(dense(spark, d)), 50, "pix_tp", "pix_fp", "pix_fn"))


@query("w02_running_maximum", f"WITH {SWEEP_CTE} SELECT thr_idx, max(pix_tp % 97) OVER (ORDER BY thr_idx ROWS UNBOUNDED PRECEDING) AS top FROM sw")
def w02(spark, d):
    from pyspark.sql import Window

    return P.sweep(dense(spark, d)).select("thr_idx", F.max(F.col("pix_tp") % 97).over(Window.orderBy("thr_idx").rowsBetween(Window.unboundedPreceding, 0)).alias("top"))


@query("w03_trapezoid", f"WITH {ROC_CTE}, z AS (SELECT (fpr-lag(fpr) OVER (ORDER BY pos))*(tpr+lag(tpr) OVER (ORDER BY pos))/2 AS v FROM roc) SELECT round(coalesce(sum(v),0),6) AS area FROM z")
def w03(spark, d):
    return rounded(P.trapezoid(C.roc(P.sweep(dense(spark, d))), "fpr", "tpr", "pos"))


def partial_sql(curve: str, x_max: float) -> str:
    return f"""(SELECT coalesce(sum(v),0) FROM (SELECT (fpr-lag(fpr) OVER (ORDER BY pos))*(tpr+lag(tpr) OVER (ORDER BY pos))/2 AS v FROM (SELECT pos, fpr, tpr FROM {curve} WHERE fpr <= {x_max}
 UNION ALL SELECT 0, 0.0, 0.0 WHERE (SELECT min(fpr) FROM {curve}) > 0
 UNION ALL SELECT 1000000, {x_max}, CASE WHEN (SELECT min(fpr) FROM {curve}) > {x_max} THEN (SELECT tpr FROM {curve} ORDER BY pos LIMIT 1) WHEN (SELECT max(fpr) FROM {curve}) <= {x_max} THEN (SELECT tpr FROM {curve} ORDER BY pos DESC LIMIT 1)
  ELSE (SELECT l.tpr + (u.tpr-l.tpr)*({x_max}-l.fpr)/(u.fpr-l.fpr) FROM (SELECT * FROM {curve} WHERE fpr <= {x_max} ORDER BY pos DESC LIMIT 1) l, (SELECT * FROM {curve} WHERE fpr > {x_max} ORDER BY pos LIMIT 1) u) END)))"""


@query("w06_partial_auc", f"WITH {ROC_CTE} SELECT round({partial_sql('roc', 0.3)}/0.3,6) AS area")
def w06(spark, d):
    return rounded(C.partial_auc(C.roc(P.sweep(dense(spark, d))), 0.3, normalize=True))


#: Ends before, inside and beyond the points of a curve that starts late and ends early.
LIMITS = (0.05, 0.1, 0.3, 0.8, 1.0)


@query("w06_partial_auc_edges", f"WITH {ROC_CTE}, lt AS (SELECT * FROM roc WHERE fpr BETWEEN 0.08 AND 0.9) " + " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS x_max, round({partial_sql('lt', x)},6) AS area" for x in LIMITS))
def w06b(spark, d):
    late = C.roc(P.sweep(dense(spark, d))).filter("fpr between 0.08 and 0.9").select("pos", "fpr", "tpr")
    points = late.sparkSession.createDataFrame(late.collect(), late.schema)  # at most as many as thresholds
    out = None
    for x in LIMITS:
        one = C.partial_auc(points, x).select(F.lit(x).alias("x_max"), "area")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("t02_sweep_in_order", f"WITH {SWEEP_CTE} SELECT thr_idx, thr, pix_tp FROM sw ORDER BY thr")
def t02(spark, d):
    return P.sweep(dense(spark, d)).select("thr_idx", "thr", "pix_tp").orderBy("thr")


@query("t03_stable_argsort", f"WITH {SWEEP_CTE} SELECT thr_idx, CAST(row_number() OVER (ORDER BY pix_fp % 7, thr_idx) AS INT) AS place FROM sw")
def t03(spark, d):
    from pyspark.sql import Window

    return P.sweep(dense(spark, d)).select("thr_idx", F.row_number().over(Window.orderBy(F.col("pix_fp") % 7, "thr_idx")).alias("place"))


@query("t04_best_threshold", f"WITH {SWEEP_CTE}, f AS (SELECT *, coalesce(round(5.0*pix_tp/nullif(5*pix_tp+4*pix_fn+pix_fp,0),6),0) AS f2 FROM sw) SELECT thr, f2 AS score FROM f ORDER BY f2 DESC, thr_idx LIMIT 1")
def t04(spark, d):
    return rounded(C.best_threshold(rounded(P.sweep(dense(spark, d))), "pix_f2"))


@query("w07_sobel", f"""{W}, k AS (SELECT dr, dc, CASE WHEN dr=0 THEN 2 ELSE 1 END*dc AS gx, CASE WHEN dc=0 THEN 2 ELSE 1 END*dr AS gy FROM (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc))
 SELECT a.image_id, a.r, a.c, round(sum(b.p*gx),6)+0.0 AS gx, round(sum(b.p*gy),6)+0.0 AS gy FROM px8 a, k JOIN px8 b ON b.image_id=a.image_id AND b.r=a.r+dr AND b.c=a.c+dc GROUP BY 1,2,3""")
def w07(spark, d):
    return rounded(P.sobel_l1(dense(spark, d))).withColumn("gx", F.col("gx") + 0.0).withColumn("gy", F.col("gy") + 0.0)


@query("w07_dilation", f"{W} SELECT DISTINCT image_id, CAST(r+dr AS INT) AS r, CAST(c+dc AS INT) AS c FROM px8, (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc) WHERE p >= 0.8")
def w07b(spark, d):
    return P.dilate(dense(spark, d).filter("p >= 0.8"), 1)


@query("a30_soft_iou", f"{W}, e AS (SELECT 1 - sum(p*gt::INT)/(sum(p+gt::INT-p*gt::INT)+1e-6) AS l FROM px8 GROUP BY image_id) SELECT round(avg(l),6) AS loss FROM e")
def a30(spark, d):
    return rounded(P.soft_iou_loss(dense(spark, d)))


FT = "SELECT round(avg(l),6) AS loss FROM (SELECT pow(1 - (sum(p*gt::INT)+1e-6)/(sum(p*gt::INT)+{0}*sum(p*(1-gt::INT))+{1}*sum((1-p)*gt::INT)+1e-6), 1.3) AS l FROM px8 {2} GROUP BY image_id)"


@query("a31_focal_tversky", f"{W} {FT.format(0.45, 0.55, '')}")
def a31(spark, d):
    return rounded(P.focal_tversky(dense(spark, d)))


@query("a34_masked_focal_tversky", f"{W} {FT.format(0.4, 0.6, 'WHERE real=0')}")
def a34(spark, d):
    return rounded(P.focal_tversky(P.valid(dense(spark, d)), 0.4, 0.6))


BCE = "{0}*gt::INT*(greatest(-flux,0)+ln(1+exp(-abs(flux)))) + (1-gt::INT)*(greatest(flux,0)+ln(1+exp(-abs(flux))))"


@query("a33_masked_bce", f"{W} SELECT round(sum(l*v)/greatest(sum(v),1),6) AS loss FROM (SELECT {BCE.format(3.0)} AS l, 1-real AS v FROM px8)")
def a33(spark, d):
    return rounded(P.masked_bce(dense(spark, d), F.col("flux"), 3.0))


@query("a32_bce_iou_edge", f"""{W}, k AS (SELECT dr, dc, CASE WHEN dr=0 THEN 2 ELSE 1 END*dc AS gx, CASE WHEN dc=0 THEN 2 ELSE 1 END*dr AS gy FROM (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc)),
 s AS (SELECT a.image_id, a.r, a.c, sum(b.p*gx) AS px, sum(b.p*gy) AS py, sum(b.gt::INT*gx) AS tx, sum(b.gt::INT*gy) AS ty FROM px8 a, k JOIN px8 b ON b.image_id=a.image_id AND b.r=a.r+dr AND b.c=a.c+dc GROUP BY 1,2,3)
 SELECT round((SELECT avg({BCE.format(2.0)}) FROM px8) + (SELECT avg(l) FROM (SELECT 1 - sum(p*gt::INT)/(sum(p+gt::INT-p*gt::INT)+1e-6) AS l FROM px8 GROUP BY image_id)) + 0.1*(SELECT avg(abs(sqrt(px*px+py*py+1e-12)-sqrt(tx*tx+ty*ty+1e-12))) FROM s), 6) AS loss""")
def a32(spark, d):
    px = dense(spark, d).withColumn("t", F.col("gt").cast("double"))
    size = lambda df, n: df.select("image_id", "r", "c", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + 1e-12).alias(n))
    edge = size(P.sobel_l1(px, "p"), "e").join(size(P.sobel_l1(px, "t"), "g"), ["image_id", "r", "c"]).agg(F.avg(F.abs(F.col("e") - F.col("g"))).alias("edge"))
    bce = px.agg(F.avg(P.bce_with_logits(F.col("flux"), F.col("t"), 2.0)).alias("bce"))
    return rounded(bce.join(P.soft_iou_loss(px)).join(edge).select((F.col("bce") + F.col("loss") + 0.1 * F.col("edge")).alias("loss")))


@query("a39_weighted_mean_loss", f"{W}, b AS (SELECT image_id % 8 AS batch, avg(p) AS l, count(*) AS n FROM px8 GROUP BY 1) SELECT round(sum(l*n)/greatest(sum(n),1),6) AS loss FROM b")
def a39(spark, d):
    b = dense(spark, d).groupBy((F.col("image_id") % 8).alias("batch")).agg(F.avg("p").alias("l"), F.count("*").alias("n"))
    return rounded(b.agg((F.sum(F.col("l") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("loss")))


@query("w09_moving_average", f"{W} SELECT image_id, round(list_reduce(list(p ORDER BY r*8+c), lambda s, x: 0.9*s + 0.1*x),6) AS ema FROM px8 GROUP BY 1")
def w09(spark, d):
    px = dense(spark, d).withColumn("step", F.col("r") * DENSE + F.col("c"))
    return rounded(C.moving_average(px, "image_id", "step", "p", 0.9))


@query("w10_running_best", f"{W}, e AS (SELECT image_id AS epoch, avg(p) AS auc FROM px8 GROUP BY 1), z AS (SELECT *, max(auc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, max(auc) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM e) SELECT epoch, round(auc,6) AS auc, coalesce(auc > b, true) AS improved, round(best,6) AS best FROM z")
def w10(spark, d):
    e = dense(spark, d).groupBy(F.col("image_id").alias("epoch")).agg(F.avg("p").alias("auc"))
    return rounded(C.running_best(e, "auc", "epoch"))


@query("g09_resize_nearest", f"{W} SELECT image_id, CAST(i AS INT) AS r, CAST(j AS INT) AS c, p FROM (SELECT image_id, r, c, round(p,6) AS p FROM px8), range(5) a(i), range(5) b(j) WHERE r = CAST(floor(i*8/5) AS INT) AND c = CAST(floor(j*8/5) AS INT)")
def g09(spark, d):
    from lumenframe.operators.tiles import resize_nearest

    return rounded(resize_nearest(dense(spark, d).select("image_id", "r", "c", "p"), DENSE, DENSE, 5, 5))


@query("g10_centre_crop", f"{W} SELECT image_id, CAST(r-2 AS INT) AS r, CAST(c-2 AS INT) AS c, round(p,6) AS p FROM px8 WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5")
def g10(spark, d):
    from lumenframe.operators.tiles import centre_crop_pad

    return rounded(centre_crop_pad(dense(spark, d).select("image_id", "r", "c", "p"), DENSE, DENSE, 4, 4))
