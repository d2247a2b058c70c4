"""Queries of rasters, tile scans and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.config import Config
from lumenframe.operators import components as K
from lumenframe.operators import objects as M
from lumenframe.operators import pixels as P
from lumenframe.operators import raster as R
from lumenframe.operators import sampling as S
from lumenframe.operators import tiles as T
from lumenframe.plans.catalog_queries import SPANS
from lumenframe.plans.object_queries import EDGES, GAP, MEASURE, THR, TILE, TOUCH, TRAIL_SQL, WIDTH, WL, images
from lumenframe.plans.pixel_queries import STATS, SWEEP_CTE
from lumenframe.plans.registry import query, rounded
from lumenframe.plans.scenes import CATALOG_SQL, DENSE, DENSE_SQL, EXP_SQL, SPARSE, SPARSE_SQL, STACK_SQL, catalog, dense, exposures, order_key, order_sql, sparse, stack_pixels

INSIDE = "r BETWEEN 0 AND 127 AND c BETWEEN 0 AND 127"


def stamp_sql(points: str, offsets: str) -> str:
    return f"WITH {CATALOG_SQL}, {points}, st AS (SELECT image_id, row_pos, CAST(r0+a AS INT) AS r, CAST(c0+b AS INT) AS c FROM pt, {offsets}) SELECT DISTINCT image_id, row_pos, r, c FROM st WHERE {INSIDE}"


def near(v: str) -> str:
    return f"CAST(round_even(round({v}, 9), 0) AS INT)"


DISK2 = "(SELECT a, b FROM (SELECT unnest(range(-2,3)) AS a), (SELECT unnest(range(-2,3)) AS b) WHERE a*a+b*b <= 4)"
SQUARE1 = "(SELECT unnest(range(-1,2)) AS a), (SELECT unnest(range(-1,2)) AS b)"


@query("g02_trail_from_start", stamp_sql(f"pt AS (SELECT image_id, row_pos, {near('x + trail_length*i/(n-1)*sin(radians(beta))')} AS c0, {near('y - trail_length*i/(n-1)*cos(radians(beta))')} AS r0 FROM (SELECT *, CAST(greatest(2, floor(trail_length)) AS INT) AS n FROM cat), range(60) t(i) WHERE i < n)", DISK2))
def g02(spark, d):
    return R.trail_from_start(catalog(spark, d), SPARSE, SPARSE, 4)


@query("g03_line_mask", stamp_sql(f"pt AS (SELECT image_id, row_pos, greatest(0, least(127, {near('x + trail_length*(i/(n-1) - 0.5)*cos(radians(beta))')})) AS c0, greatest(0, least(127, {near('y + trail_length*(i/(n-1) - 0.5)*sin(radians(beta))')})) AS r0 FROM (SELECT *, CAST(greatest(2, ceil(2*trail_length)) AS INT) AS n FROM cat), range(130) t(i) WHERE i < n)", SQUARE1))
def g03(spark, d):
    return R.line_mask(catalog(spark, d), SPARSE, SPARSE, 3)


@query("g04_disk_mask", stamp_sql("pt AS (SELECT image_id, row_pos, y AS r0, x AS c0 FROM cat)", DISK2))
def g04(spark, d):
    return R.disk_mask(catalog(spark, d), SPARSE, SPARSE, 2)


TAPS = "(SELECT CAST(i AS INT) AS o, CAST(floor(s) AS INT) AS s0, least(CAST(floor(s) AS INT)+1, 7) AS s1, s - floor(s) AS f FROM (SELECT i, greatest(0, (i+0.5)*8/5.0 - 0.5) AS s FROM range(5) t(i)))"
TAPS2 = f"(SELECT o, s0 AS s, 1-f AS k FROM {TAPS} UNION ALL SELECT o, s1, f FROM {TAPS})"


@query("g09_resize_bilinear", f"WITH {DENSE_SQL} SELECT image_id, a.o AS r, b.o AS c, round(sum(p*a.k*b.k),6) AS p FROM px8 JOIN {TAPS2} a ON a.s=r JOIN {TAPS2} b ON b.s=c GROUP BY 1,2,3")
def g09b(spark, d):
    return rounded(R.resize_bilinear(dense(spark, d), DENSE, DENSE, 5, 5))


@query("g15_image_dimensions", f"WITH {SPARSE_SQL} SELECT image_id, CAST(max(r)+1 AS INT) AS h, CAST(max(c)+1 AS INT) AS w FROM pxs GROUP BY 1")
def g15(spark, d):
    return sparse(spark, d).groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


@query("s01_tile_scan", f"WITH {DENSE_SQL}, {STATS} SELECT image_id, CAST(r//4 AS INT) AS tr, CAST(c//4 AS INT) AS tc, list(round(greatest(-5, least(5, (flux-med)/sigma)),6) ORDER BY r, c) AS data FROM px8 JOIN st USING (image_id) GROUP BY 1,2,3")
def s01(spark, d):
    px = dense(spark, d)
    z = P.normalise(px, P.robust_stats(px))
    # As in SQL, a value that rounds to zero keeps its sign.
    signed = F.when(F.col("z") < 0, -F.round(-F.col("z"), 6)).when(F.col("z") == 0, F.col("z")).otherwise(F.round("z", 6))
    return T.tile_arrays(z.withColumn("z", signed), 4, "z")


@query("s10_full_scan", f"WITH {DENSE_SQL} SELECT image_id, CAST(sum(gt::INT) AS BIGINT) AS masks, CAST(sum(real) AS BIGINT) AS reals FROM px8 GROUP BY 1")
def s10(spark, d):
    return dense(spark, d).groupBy("image_id").agg(F.sum(F.col("gt").cast("int")).alias("masks"), F.sum("real").alias("reals"))


@query("f06_subset_in_order", f"WITH {CATALOG_SQL}, ids AS (SELECT image_id, row_number() OVER (ORDER BY max(SNR) DESC, image_id) AS pos FROM cat GROUP BY 1) SELECT image_id, CAST(a AS INT) AS tr, CAST(b AS INT) AS tc, CAST((pos-1)*16 + a*4 + b AS BIGINT) AS at FROM ids, range(4) t(a), range(4) u(b) WHERE pos <= 25")
def f06(spark, d):
    from pyspark.sql import Window

    first = catalog(spark, d).groupBy("image_id").agg(F.max("SNR").alias("s")).orderBy(F.desc("s"), "image_id").limit(25)
    ids = first.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("s"), "image_id")))  # 25 rows
    tiles = T.enumerate_tiles(images(spark, d), SPARSE, SPARSE, TILE).join(ids, "image_id")
    return tiles.select("image_id", "tr", "tc", ((F.col("pos") - 1) * 16 + F.col("tile_index")).cast("long").alias("at"))


@query("a35_all_reduce", f"WITH {SWEEP_CTE} SELECT CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, round(avg(pos),6) AS mean FROM h")
def a35(spark, d):
    h = P.histogram(dense(spark, d), P.sweep_bin(4096))
    return rounded(h.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.avg("pos").alias("mean")))


@query("a37_throughput", "WITH k AS (SELECT event_id % 20 AS worker, epoch(ts) AS sec, value, row_number() OVER (PARTITION BY event_id % 20 ORDER BY ts, event_id) AS n FROM events), b AS (SELECT worker, min(sec) FILTER (n = 10) AS t0, max(sec) AS t1, count(*) FILTER (n > 10) AS batches, sum(round(value,2)) FILTER (n > 10) AS tiles FROM k WHERE n <= 110 GROUP BY 1) SELECT CAST(worker AS BIGINT) AS worker, batches, round(batches/(t1-t0),6) AS batches_per_s, round(tiles/(t1-t0),6) AS tiles_per_s FROM b")
def a37(spark, d):
    from lumenframe.plans.scenes import table

    e = table(spark, d, "events").select((F.col("event_id") % 20).alias("worker"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.round("value", 2).alias("tiles"), "event_id")
    return rounded(S.throughput(e, "worker", "at", "event_id", "tiles", 10, 100))


@query("d05_training_tiles", f"""WITH {SPARSE_SQL}, {STACK_SQL}, {CATALOG_SQL}, {TOUCH}, m AS (SELECT image_id, tr, tc, bool_or(NOT stack_detection) AS missed, bool_or(stack_detection) AS detected FROM tch GROUP BY 1,2,3),
 f AS (SELECT image_id, CAST(r//32 AS INT) AS tr, CAST(c//32 AS INT) AS tc, count(*) AS n, count(stk.image_id) AS real FROM pxs LEFT JOIN stk USING (image_id, r, c) GROUP BY 1,2,3)
 SELECT image_id, tr, tc, n, real, coalesce(missed, false) AS missed, coalesce(detected, false) AS detected FROM f LEFT JOIN m USING (image_id, tr, tc)""")
def d05(spark, d):
    side = stack_pixels(spark, d).withColumn("real", F.lit(1))
    px = sparse(spark, d).join(side, ["image_id", "r", "c"], "left")
    t = px.groupBy("image_id", F.floor(F.col("r") / TILE).cast("int").alias("tr"), F.floor(F.col("c") / TILE).cast("int").alias("tc")).agg(F.count("*").alias("n"), F.count("real").alias("real"))
    return T.tile_flags(t, catalog(spark, d), SPARSE, SPARSE, TILE, 4.0).select("image_id", "tr", "tc", "n", "real", "missed", "detected")


@query("o04_fixed_assignment", f"WITH {EXP_SQL}, n AS (SELECT ref_id, valid, row_number() OVER (ORDER BY {order_sql()}, ref_id) - 1 AS i FROM expo) SELECT CAST(i % 8 AS INT) AS worker, count(*) AS attempts, count(*) FILTER (valid) AS ok FROM n GROUP BY 1")
def o04(spark, d):
    n = S.numbered(exposures(spark, d), order_key(), "ref_id", "i")
    return n.groupBy((F.col("i") % 8).cast("int").alias("worker")).agg(F.count("*").alias("attempts"), F.count_if("valid").alias("ok"))


@query("k08_roc_frame", f"WITH {SWEEP_CTE} SELECT thr, round(coalesce(pix_tp/nullif(pix_tp+pix_fn,0),0),6) AS tpr, round(coalesce(pix_fp/nullif(pix_fp+pix_tn,0),0),6) AS fpr FROM sw")
def k08(spark, d):
    s = P.sweep(dense(spark, d))
    return rounded(s.select("thr", P.ratio(F.col("pix_tp"), F.col("pix_tp") + F.col("pix_fn")).alias("tpr"), P.ratio(F.col("pix_fp"), F.col("pix_fp") + F.col("pix_tn")).alias("fpr")))


RUN_SQL = f"""{WL}, {CATALOG_SQL}, {MEASURE}, {EDGES}, ok AS (SELECT image_id, label FROM ms WHERE area >= 2), e2 AS (SELECT * FROM ed SEMI JOIN ok USING (image_id, label)), o2 AS (SELECT image_id, label, min(row_pos) AS owner FROM e2 GROUP BY 1,2)
 SELECT image_id, row_pos, row_pos IN (SELECT row_pos FROM e2) AS nn_detected, row_pos IN (SELECT owner FROM o2) AS tp FROM cat"""


@query("o01_detection_run", RUN_SQL)
def o01(spark, d):
    """A whole run: components of every image, accepted ones, and each object's match."""
    p = Config().validate().detection
    lab = K.label_components(sparse(spark, d).filter(F.col("p") >= THR), GAP)
    kept = K.accept(K.measure(lab, p.score_method, p.topk_fraction), 2, p.max_area, p.min_score, p.min_peak_probability)
    used = lab.join(kept.select("image_id", "label"), ["image_id", "label"], "left_semi")
    cat = catalog(spark, d)
    return M.match(cat, M.edges(cat, used, WIDTH)).select("image_id", "row_pos", "nn_detected", "tp")


SIMULATE_SQL = f"""WITH {CATALOG_SQL}, {SPARSE_SQL}, {SPANS}, {TRAIL_SQL}, fb AS (SELECT image_id, r, c FROM pxs WHERE ((r*31 + c) & 36) <> 0 UNION SELECT image_id, r, c FROM fpx),
 k AS (SELECT image_id, row_pos % 10 AS slot, row_pos AS try, r, c FROM gp), bad AS (SELECT DISTINCT try FROM k SEMI JOIN fb USING (image_id, r, c)), pl AS (SELECT image_id, slot, min(try) AS row_pos FROM k WHERE try NOT IN (SELECT try FROM bad) GROUP BY 1,2),
 inj AS (SELECT gp.image_id, gp.row_pos, gp.r, gp.c, pow(10, -0.4*(20 + row_pos % 30/10.0 - 25))/count(*) OVER (PARTITION BY row_pos) AS flux FROM gp SEMI JOIN pl USING (row_pos)),
 post AS (SELECT image_id, r, c, sum(flux) AS flux FROM (SELECT image_id, r, c, p AS flux FROM pxs UNION ALL SELECT image_id, r, c, flux FROM inj) GROUP BY 1,2,3), det AS (SELECT image_id, r, c FROM post WHERE flux >= 0.9)
 SELECT pl.image_id, pl.slot, pl.row_pos, count(*) AS pixels, count(det.r) AS found, count(det.r) >= greatest(1, floor(0.3*count(*))) AS detected FROM pl JOIN gp ON gp.row_pos=pl.row_pos LEFT JOIN det ON det.image_id=gp.image_id AND det.r=gp.r AND det.c=gp.c GROUP BY 1,2,3"""


@query("o01_simulation", SIMULATE_SQL)
def o01b(spark, d):
    from lumenframe.operators import sky as Y
    from lumenframe.plans.catalog_queries import sources

    cat, px = catalog(spark, d), sparse(spark, d)
    mask = px.select("image_id", "r", "c", (F.col("r") * 31 + F.col("c")).alias("mask"))
    blocked = Y.forbidden(mask, [2, 5], Y.label_raster(sources(spark, d)))
    tries = M.trail_pixels(cat, WIDTH, SPARSE, SPARSE).withColumn("slot", F.col("row_pos") % 10)
    flux = F.pow(F.lit(10.0), -0.4 * (20 + F.col("row_pos") % 30 / 10 - 25))
    return Y.simulate(tries, blocked, px.withColumnRenamed("p", "flux"), flux, 0.9, 0.3, 1)
