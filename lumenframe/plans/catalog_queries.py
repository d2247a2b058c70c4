"""Queries over catalogs, exposures, sky sources and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import photometry as X
from lumenframe.operators import histograms as H
from lumenframe.operators import objects as O
from lumenframe.operators import raster as G
from lumenframe.operators import sampling as S
from lumenframe.operators import sky as Y
from lumenframe.operators import tasks as K
from lumenframe.plans import scenes as Z
from lumenframe.plans.registry import query, rounded
from lumenframe.plans.scenes import CATALOG_SQL, DENSE_SQL, EPH_SQL, EXP_SQL, SKY_SQL, SPARSE_SQL, catalog, dense, ephemerides, exposures, order_key, order_sql, sky, sparse
from lumenframe.sources import readers as R

WC, WE, WX = f"WITH {CATALOG_SQL}", f"WITH {EPH_SQL}", f"WITH {EXP_SQL}"


# Histograms and flags

HIST = """e AS (SELECT min({f}) AS lo, max({f}) AS hi FROM cat WHERE {w}), b AS (SELECT CAST(least(floor(({f}-lo)/((hi-lo)/12)), 11) AS INT) AS bin, nn_detected AS a, stack_detection AS s FROM cat, e WHERE {w})
 SELECT bin, count(*) AS n, count(*) FILTER (a) AS nn, count(*) FILTER (s) AS stack, count(*) FILTER (a OR s) AS either, count(*) FILTER (a AND NOT s) AS nn_only, round(count(*) FILTER (a OR s)/count(*),6) AS completeness FROM b GROUP BY 1"""


@query("a15_detection_histogram", f"{WC}, {HIST.format(f='SNR', w='TRUE')}")
def a15(spark, d):
    return rounded(H.detection_histogram(catalog(spark, d), "SNR"))


@query("a15_histogram_limited", f"{WC}, {HIST.format(f='trail_length', w='trail_length BETWEEN 10 AND 40')}")
def a15b(spark, d):
    return rounded(H.detection_histogram(catalog(spark, d), "trail_length", xlim=(10.0, 40.0)))


@query("a16_completeness_2d", f"""{WC}, b AS (SELECT CAST(least(floor((SNR-2)/(6.0/8)),7) AS INT) AS bin_x, CAST(least(floor((trail_length-6)/(54.0/6)),5) AS INT) AS bin_y, nn_detected AS a FROM cat WHERE SNR BETWEEN 2 AND 8 AND trail_length BETWEEN 6 AND 60),
 c AS (SELECT bin_x, bin_y, count(*) AS total, count(*) FILTER (a) AS detected FROM b GROUP BY 1,2) SELECT CAST(i AS INT) AS bin_x, CAST(j AS INT) AS bin_y, coalesce(total,0) AS total, coalesce(detected,0) AS detected, round(coalesce(detected/total,0),6) AS ratio FROM range(8) x(i) CROSS JOIN range(6) y(j) LEFT JOIN c ON bin_x=i AND bin_y=j""")
def a16(spark, d):
    return rounded(H.completeness_2d(catalog(spark, d), "SNR", "trail_length", 8, 6, (2.0, 8.0), (6.0, 60.0), F.col("nn_detected")))


@query("f02_stack_flag_filter", f"{WC} SELECT row_pos FROM cat WHERE CAST(stack_detection AS INT) = 0")
def f02(spark, d):
    return catalog(spark, d).filter(F.col("stack_detection").cast("int") == 0).select("row_pos")


@query("f08_flag_fallback", f"{WC} SELECT row_pos, stack_mag IS NOT NULL AS flag FROM cat")
def f08(spark, d):
    cat = catalog(spark, d).drop("stack_detection")
    return cat.select("row_pos", O.stack_flag(cat.columns).alias("flag"))


@query("f11_required_columns", f"{WC} SELECT image_id, x, y, beta, trail_length FROM cat")
def f11(spark, d):
    need = ["image_id", "x", "y", "beta", "trail_length"]
    return R.require(catalog(spark, d), need).select(*need)


@query("f12_finite_range", f"{WC} SELECT row_pos, round(stack_mag,6) AS stack_mag FROM cat WHERE stack_mag BETWEEN 21 AND 24")
def f12(spark, d):
    return rounded(catalog(spark, d).filter(H.finite("stack_mag", 21.0, 24.0)).select("row_pos", "stack_mag"))


@query("f13_known_images", f"WITH {SPARSE_SQL}, {CATALOG_SQL} SELECT row_pos, image_id IN (SELECT image_id FROM pxs) AND nn_detected AS nn FROM cat")
def f13(spark, d):
    ids = sparse(spark, d).select("image_id").distinct().withColumn("k", F.lit(True))
    return catalog(spark, d).join(ids, "image_id", "left").select("row_pos", (F.coalesce("k", F.lit(False)) & F.col("nn_detected")).alias("nn"))


@query("f15_detector_sets", f"{WC} SELECT row_pos, nn_detected OR stack_detection AS either, nn_detected AND NOT stack_detection AS nn_only FROM cat")
def f15(spark, d):
    a, b = F.col("nn_detected"), F.col("stack_detection")
    return catalog(spark, d).select("row_pos", (a | b).alias("either"), (a & ~b).alias("nn_only"))


@query("u01_union_of_detections", f"{WC} SELECT row_pos FROM cat WHERE nn_detected UNION SELECT row_pos FROM cat WHERE stack_detection")
def u01(spark, d):
    cat = catalog(spark, d)
    return cat.filter("nn_detected").select("row_pos").union(cat.filter("stack_detection").select("row_pos")).distinct()


@query("x01_scores", f"{WC}, k AS (SELECT image_id, count(*) FILTER (nn_detected AND stack_detection) AS tp, count(*) FILTER (nn_detected AND NOT stack_detection) AS fp, count(*) FILTER (NOT nn_detected AND stack_detection) AS fn FROM cat GROUP BY 1) SELECT image_id, round(coalesce(tp/nullif(tp+fp,0),0),6) AS precision, round(coalesce(tp/nullif(tp+fn,0),0),6) AS recall, round(coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0),6) AS f1, round(coalesce(5.0*tp/nullif(5*tp+4*fn+fp,0),0),6) AS f2 FROM k")
def x01(spark, d):
    from lumenframe.operators.pixels import count_if, scores

    a, b = F.col("nn_detected"), F.col("stack_detection")
    k = catalog(spark, d).groupBy("image_id").agg(count_if(a & b).alias("tp"), count_if(a & ~b).alias("fp"), count_if(~a & b).alias("fn"))
    return rounded(k.select("image_id", *scores("tp", "fp", "fn")))


@query("x02_fppi", f"{WC} SELECT image_id, round(count(*) FILTER (nn_detected AND NOT stack_detection)/50.0,6) AS fppi FROM cat GROUP BY 1")
def x02(spark, d):
    return rounded(catalog(spark, d).groupBy("image_id").agg((F.count_if(F.col("nn_detected") & ~F.col("stack_detection")) / F.lit(50)).alias("fppi")))


@query("x03_scores_unguarded", f"{WC}, k AS (SELECT image_id, count(*) FILTER (nn_detected AND stack_detection) AS tp, count(*) FILTER (nn_detected <> stack_detection) AS bad FROM cat GROUP BY 1) SELECT image_id, round(2.0*tp/nullif(2*tp+bad,0),6) AS f1 FROM k")
def x03(spark, d):
    a, b = F.col("nn_detected"), F.col("stack_detection")
    k = catalog(spark, d).groupBy("image_id").agg(F.count_if(a & b).alias("tp"), F.count_if(a != b).alias("bad"))
    return rounded(k.select("image_id", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("bad")).alias("f1")))


# Angles, rates and magnitudes

FOLDED = "round(degrees(atan2(sin(radians(beta*3)), cos(radians(beta*3)))),6)"
ANGLES = f"{WC} SELECT row_pos, round(radians(beta),6) AS rad, round(CASE WHEN abs(beta) > 2*pi() THEN radians(beta) ELSE beta END,6) AS heuristic, CASE WHEN {FOLDED} = -180 THEN 180.0::DOUBLE ELSE {FOLDED} + 0.0::DOUBLE END AS wrapped FROM cat"


@query("x04_x06_angles", ANGLES)
def x04(spark, d):
    # Half a turn is 180 here, whichever sign the sine's rounding gives it.
    b = F.col("beta")
    wrapped = F.round(X.wrap_degrees(b * 3), 6)
    return rounded(catalog(spark, d).select("row_pos", F.radians(b).alias("rad"), X.ensure_radians(b).alias("heuristic"), F.when(wrapped == -180, 180.0).otherwise(wrapped + 0.0).alias("wrapped")))


SPEED = "sqrt(RARateCosDec_deg_day**2 + DecRate_deg_day**2)"


@query("x07_speed_and_angle", f"{WE} SELECT event_id, round({SPEED},6) AS vsky, round(CASE WHEN a < 0 THEN a + 360 ELSE a END % 360,5) AS pa FROM (SELECT *, degrees(atan2(RARateCosDec_deg_day, DecRate_deg_day)) AS a FROM eph)")
def x07(spark, d):
    a, b = F.col("RARateCosDec_deg_day"), F.col("DecRate_deg_day")
    return ephemerides(spark, d).select("event_id", F.round(X.sky_speed(a, b), 6).alias("vsky"), F.round(X.position_angle(a, b), 5).alias("pa"))


@query("x08_trail_length", f"{WE} SELECT event_id, round({SPEED}*3600/86400*30/0.2,6) AS trail FROM eph")
def x08(spark, d):
    v = X.sky_speed(F.col("RARateCosDec_deg_day"), F.col("DecRate_deg_day"))
    return rounded(ephemerides(spark, d).select("event_id", X.trail_pixels(v, 30.0, 0.2).alias("trail")))


@query("f03_speed_filter", f"{WE} SELECT event_id FROM eph WHERE {SPEED} > 0.5")
def f03(spark, d):
    e = ephemerides(spark, d).withColumn("vsky_deg_day", X.sky_speed(F.col("RARateCosDec_deg_day"), F.col("DecRate_deg_day")))
    return e.filter("vsky_deg_day > 0.5").select("event_id")


@query("x09_mag_to_snr", f"{WC} SELECT row_pos, round(5*pow(10, 0.4*(24.5-stack_mag)),4) AS snr FROM cat")
def x09(spark, d):
    return catalog(spark, d).select("row_pos", F.round(X.snr_of(F.col("stack_mag"), F.lit(24.5)), 4).alias("snr"))


@query("x10_snr_to_mag", f"{WC} SELECT row_pos, round(CASE WHEN SNR-4 > 0 THEN 24.5 - 2.5*log10((SNR-4)/5) END,6) AS mag FROM cat")
def x10(spark, d):
    return rounded(catalog(spark, d).select("row_pos", X.mag_of(F.col("SNR") - 4, F.lit(24.5)).alias("mag")))


SIGMA_SQL = "sg AS (SELECT image_id, sqrt(sum(tpl*tpl/v))/sum(tpl*(tpl+0.1)/v) AS sf FROM stp GROUP BY 1), mk AS (SELECT *, pow(greatest(trail_length,0)/20.0, 1.5) AS q FROM cat LEFT JOIN sg USING (image_id))"


def measured(spark, d):
    """The catalog with the flux sigma of its images' stamps and the correction for length."""
    sigma = H.flux_sigma(stamps(spark, d).withColumn("t2", F.col("tpl") + 0.1), "tpl", "t2", "v")
    return catalog(spark, d).join(sigma, "image_id", "left").withColumn("k", X.snr_correction(F.col("trail_length"), 0.8, 0.3, 20.0, 1.5))


@query("x09_mag_to_snr_measured", lambda: f"WITH {CATALOG_SQL}, {STAMP}, {SIGMA_SQL} SELECT row_pos, round(pow(10, 0.4*(23-stack_mag))/sf*(0.8+0.3*q/(1+q)),5) AS snr FROM mk")
def x09b(spark, d):
    return measured(spark, d).select("row_pos", F.round(X.snr_measured(F.col("stack_mag"), 23.0, F.col("sigma_f"), F.col("k")), 5).alias("snr"))


@query("x10_snr_to_mag_measured", lambda: f"WITH {CATALOG_SQL}, {STAMP}, {SIGMA_SQL} SELECT row_pos, round(CASE WHEN (SNR-4)*sf > 0 THEN 23 - 2.5*log10((SNR-4)*sf/(0.8+0.3*q/(1+q))) END,6) AS mag FROM mk")
def x10b(spark, d):
    return rounded(measured(spark, d).select("row_pos", X.mag_measured(F.col("SNR") - 4, 23.0, F.col("sigma_f"), F.col("k")).alias("mag")))


@query("x11_length_correction", f"{WC}, k AS (SELECT row_pos, pow(greatest(trail_length,0)/20.0, 1.5) AS x FROM cat) SELECT row_pos, round(0.8 + 0.3*x/(1+x),6) AS corr FROM k")
def x11(spark, d):
    return rounded(catalog(spark, d).select("row_pos", X.snr_correction(F.col("trail_length"), 0.8, 0.3, 20.0, 1.5).alias("corr")))


@query("x12_midpoint", f"{WC} SELECT row_pos, round(x + trail_length/2*cos(radians(beta)),6) AS mx, round(y + trail_length/2*sin(radians(beta)),6) AS my FROM cat")
def x12(spark, d):
    mx, my = X.midpoint(F.col("x"), F.col("y"), F.col("trail_length"), F.radians("beta"))
    return rounded(catalog(spark, d).select("row_pos", mx.alias("mx"), my.alias("my")))


@query("x14_injection_photometry", f"{WC}, k AS (SELECT *, (CASE WHEN row_pos % 4 = 0 THEN 0 ELSE trail_length END) AS l FROM cat) SELECT row_pos, CASE WHEN l > 0 THEN 'Trail' ELSE 'Star' END AS source_type, round(1.25*log10(1 + 0.42*(l/4.0)*(l/4.0)),6) AS loss, round(CASE WHEN l > 0 THEN 22 + 2.5*log10(l) ELSE 22 END,6) AS mag FROM k")
def x14(spark, d):
    cat = catalog(spark, d).withColumn("l", F.when(F.col("row_pos") % 4 == 0, 0.0).otherwise(F.col("trail_length")))
    return rounded(cat.select("row_pos", X.source_type(F.col("l")).alias("source_type"), X.trailing_loss(F.col("l"), F.lit(4.0)).alias("loss"), X.surface_brightness(F.lit(22.0), F.col("l")).alias("mag")))


MODES = {"snr": "24.5 - 2.5*log10(greatest(2 + row_pos % 60/10.0, 0.01)/5) - loss", "psf_mag": "20 + row_pos % 40/10.0 - loss", "surface_brightness": "20 + row_pos % 40/10.0 - per", "integrated_mag": "20 + row_pos % 40/10.0"}
INJECTION_SQL = f"""{WC}, k AS (SELECT row_pos, CASE WHEN row_pos % 4 = 0 THEN 0 ELSE trail_length END AS l FROM cat), z AS (SELECT *, CASE WHEN l > 0 THEN 1.25*log10(1 + 0.42*(l/4.0)*(l/4.0)) ELSE 0 END AS loss, CASE WHEN l > 0 THEN 2.5*log10(l) ELSE 0 END AS per FROM k),
 m AS ({" UNION ALL ".join(f"SELECT *, '{mode}' AS mode, {v} AS g FROM z" for mode, v in MODES.items())}) SELECT row_pos, mode, CASE WHEN l > 0 THEN 'Trail' ELSE 'Star' END AS source_type, round(g+per,6) AS mag, round(g,6) AS integrated_mag, round(g+loss,6) AS PSF_mag, round(5*pow(10, 0.4*(24.5-g-loss)),4) AS SNR FROM m"""


@query("x14_injection_modes", INJECTION_SQL)
def x14b(spark, d):
    k = F.col("row_pos")
    cat = catalog(spark, d).select("row_pos", F.when(k % 4 == 0, 0.0).otherwise(F.col("trail_length")).alias("l"))
    out = None
    for mode in MODES:
        drawn = 2 + k % 60 / 10 if mode == "snr" else 20 + k % 40 / 10
        got = X.injection(mode, drawn, F.col("l"), F.lit(4.0), F.lit(24.5))
        one = cat.select("row_pos", F.lit(mode).alias("mode"), *[(F.round(c, 4) if n == "SNR" else c).alias(n) for n, c in got.items()])
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# 5-sigma depths by band.
DEPTHS = {"1": 23.9, "2": 25.0, "3": 24.7, "4": 24.0, "5": 23.3}


@query("x15_band_lookup", f"{WX} SELECT ref_id, CASE band " + " ".join(f"WHEN '{b}' THEN {v}" for b, v in DEPTHS.items()) + " END::DOUBLE AS m5 FROM expo")
def x15(spark, d):
    return exposures(spark, d).select("ref_id", X.lookup(F.col("band"), DEPTHS).alias("m5"))


@query("x19_ramp", f"{WC} SELECT row_pos, round(greatest(0, least(1, (row_pos % 50 - 10)/20.0)),6) AS linear, round(1/(1+exp(-0.5*(row_pos % 50 - 20))),6) AS logistic, CASE WHEN row_pos % 50 >= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS step FROM cat")
def x19(spark, d):
    e = F.col("row_pos") % 50
    return rounded(catalog(spark, d).select("row_pos", X.ramp(e, "linear", 10, 30).alias("linear"), X.ramp(e, "logistic", 10, 30).alias("logistic"), X.ramp(e, "linear", 10, 10).alias("step")))


@query("x20_stage_rate", f"{WC} SELECT row_pos, CASE WHEN row_pos % 50 <= 12 THEN 0.001 WHEN row_pos % 50 <= 25 THEN 0.0003 ELSE 0.0001 END::DOUBLE AS lr FROM cat")
def x20(spark, d):
    return catalog(spark, d).select("row_pos", X.stage_rate(F.col("row_pos") % 50, (0.001, 0.0003, 0.0001)).alias("lr"))


@query("x21_task_seed", f"{WX} SELECT ref_id, (CAST(7*1000003 AS BIGINT) + visit*1003 + detector) & 4294967295 AS seed FROM expo")
def x21(spark, d):
    return exposures(spark, d).select("ref_id", X.task_seed(7, F.col("visit"), F.col("detector")).alias("seed"))


@query("x22_diagnostics", f"{WX} SELECT ref_id, 'visit=' || visit || ' | detector=' || detector AS said FROM expo")
def x22(spark, d):
    return exposures(spark, d).select("ref_id", X.diagnostics({"visit": F.col("visit"), "detector": F.col("detector")}).alias("said"))


@query("x23_json_report", f"{WX} SELECT visit, CAST(to_json({{'healthy': coalesce(list_sort(list(DISTINCT detector) FILTER (valid)), []), 'bad': coalesce(list_sort(list(DISTINCT detector) FILTER (NOT valid)), [])}}) AS VARCHAR) AS report FROM expo GROUP BY 1")
def x23(spark, d):
    e = exposures(spark, d).groupBy("visit").agg(F.array_sort(F.collect_set(F.when(F.col("valid"), F.col("detector")))).alias("healthy"), F.array_sort(F.collect_set(F.when(~F.col("valid"), F.col("detector")))).alias("bad"))
    return e.select("visit", F.to_json(F.struct("healthy", "bad")).alias("report"))


# Stamps

STAMP = DENSE_SQL + ", stp AS (SELECT image_id, r, c, flux AS phi, p AS tpl, 0.1 + abs(flux) AS v FROM px8)"


def stamps(spark, d):
    return dense(spark, d).select("image_id", "r", "c", F.col("flux").alias("phi"), F.col("p").alias("tpl"), (0.1 + F.abs("flux")).alias("v"))


CENT = "ct AS (SELECT image_id, sum(c*greatest(phi,0))/sum(greatest(phi,0)) AS cx, sum(r*greatest(phi,0))/sum(greatest(phi,0)) AS cy FROM stp GROUP BY 1)"


@query("a27_centroid", f"WITH {STAMP}, {CENT} SELECT image_id, round(cx,6) AS cx, round(cy,6) AS cy FROM ct")
def a27(spark, d):
    return rounded(H.centroid(stamps(spark, d)))


@query("a26_moment_sigma", f"WITH {STAMP}, {CENT} SELECT image_id, round(sqrt(sum(((c-cx)**2+(r-cy)**2)*greatest(phi,0))/sum(greatest(phi,0))/2),6) AS sigma FROM stp JOIN ct USING (image_id) GROUP BY 1")
def a26(spark, d):
    return rounded(H.moment_sigma(stamps(spark, d)))


@query("x13_psf_fwhm", f"WITH {STAMP}, {CENT} SELECT image_id, round(2.354820045*0.2*sqrt(sum(((c-cx)**2+(r-cy)**2)*greatest(phi,0))/sum(greatest(phi,0))/2),6) AS fwhm FROM stp JOIN ct USING (image_id) GROUP BY 1")
def x13(spark, d):
    return rounded(H.moment_sigma(stamps(spark, d)).select("image_id", X.fwhm_arcsec(F.col("sigma"), 0.2).alias("fwhm")))


@query("a28_flux_sigma", f"WITH {STAMP} SELECT image_id, round(sqrt(sum(tpl*tpl/v))/sum(tpl*(tpl+0.1)/v),6) AS sigma_f FROM stp GROUP BY 1")
def a28(spark, d):
    return rounded(H.flux_sigma(stamps(spark, d).withColumn("t2", F.col("tpl") + 0.1), "tpl", "t2", "v"))


@query("a29_local_depth", f"WITH {STAMP} SELECT image_id, round(31.4 - 2.5*log10(5*sqrt(sum(tpl*tpl*v))/sum(tpl*tpl)),6) AS m5 FROM stp GROUP BY 1")
def a29(spark, d):
    return rounded(H.local_depth(stamps(spark, d), "tpl", "v"))


@query("g11_aligned_stamps", f"WITH {SPARSE_SQL}, {CATALOG_SQL}, s AS (SELECT image_id, row_pos, CAST(a AS INT) AS a, CAST(b AS INT) AS b, y-2+a AS r, x-2+b AS c FROM cat, range(5) t(a), range(5) u(b)) SELECT row_pos, a AS r, b AS c, CASE WHEN s.r BETWEEN 0 AND 127 AND s.c BETWEEN 0 AND 127 THEN coalesce(p, 0.0) END AS p FROM s LEFT JOIN pxs USING (image_id, r, c)")
def g11(spark, d):
    return rounded(G.stamps(catalog(spark, d), sparse(spark, d), 5, Z.SPARSE, Z.SPARSE))


TEMPLATE_SQL = f"""{WC}, psf AS (SELECT CAST(u AS INT) AS u, CAST(v AS INT) AS v, exp(-((u-2.3)**2 + (v-1.9)**2)/2.0) AS value FROM range(5) a(u), range(5) b(v)), f AS (SELECT sum(u*value)/sum(value) AS cu, sum(v*value)/sum(value) AS cv, sum(value) AS s FROM psf),
 sm AS (SELECT row_pos, 24 + (i/(n-1) - 0.5)*trail_length*cos(radians(beta)) AS tx, 24 + (i/(n-1) - 0.5)*trail_length*sin(radians(beta)) AS ty FROM (SELECT *, CAST(greatest(ceil(trail_length/4)+1, 21) AS INT) AS n FROM cat), range(30) t(i) WHERE i < n),
 mv AS (SELECT row_pos, u, v, value/s AS q, floor(round(tx-cu,9)) AS x0, floor(round(ty-cv,9)) AS y0, tx-cu-floor(round(tx-cu,9)) AS fx, ty-cv-floor(round(ty-cv,9)) AS fy FROM sm, psf, f),
 im AS (SELECT row_pos, CAST(y0+v+j AS INT) AS r, CAST(x0+u+i AS INT) AS c, sum(q*(CASE WHEN i=1 THEN fx ELSE 1-fx END)*(CASE WHEN j=1 THEN fy ELSE 1-fy END)) AS x FROM mv, range(2) a(i), range(2) b(j) WHERE u+i <= 4 AND v+j <= 4 AND y0+v+j BETWEEN 0 AND 48 AND x0+u+i BETWEEN 0 AND 48 GROUP BY 1,2,3)
 SELECT row_pos, r, c, round(greatest(x,0)/sum(greatest(x,0)) OVER (PARTITION BY row_pos),6)+0.0 AS value FROM im"""


@query("g12_trail_template", TEMPLATE_SQL)
def g12(spark, d):
    at = spark.range(25).select(F.floor(F.col("id") / 5).cast("int").alias("u"), (F.col("id") % 5).cast("int").alias("v"))
    psf = at.withColumn("value", F.exp(-((F.col("u") - 2.3) ** 2 + (F.col("v") - 1.9) ** 2) / 2))
    return rounded(G.trail_template(catalog(spark, d), psf, 49, 4.0)).withColumn("value", F.col("value") + 0.0)


# Sky joins and footprints

HAV = "2*asin(least(1.0, sqrt(sin(radians((b.dec-a.dec)/2))**2 + cos(radians(a.dec))*cos(radians(b.dec))*sin(radians((b.ra-a.ra)/2))**2)))"


@query("j04_angular_antijoin", f"WITH {SKY_SQL} SELECT src_id, round(ra,6) AS ra FROM post a WHERE NOT EXISTS (SELECT 1 FROM pre b WHERE degrees({HAV}) <= 0.4/3600)")
def j04(spark, d):
    pre, post = sky(spark, d)
    return rounded(Y.unmatched(post, pre).select("src_id", "ra"))


FRAMES = "frm AS (SELECT s_suppkey % 40 AS visit, s_suppkey AS detector, 150 + (s_suppkey % 7)*0.002::DOUBLE AS ra0, 2 + (s_suppkey % 5)*0.0015::DOUBLE AS dec0 FROM supplier), pts AS (SELECT c_custkey AS point_id, c_custkey % 40 AS visit, 150 + ((c_custkey*17) % 61)*0.0002::DOUBLE AS ra, 2 + ((c_custkey*31) % 53)*0.0002::DOUBLE AS dec FROM customer)"


@query("j07_point_in_frame", f"WITH {FRAMES}, h AS (SELECT *, (ra-ra0)*cos(radians(dec0))/0.000005::DOUBLE AS px, (dec-dec0)/0.000005::DOUBLE AS py FROM pts JOIN frm USING (visit)) SELECT point_id, min(detector) AS detector FROM h WHERE px >= 0 AND px < 1000 AND py >= 0 AND py < 800 GROUP BY 1")
def j07(spark, d):
    k = F.col("s_suppkey")
    frames = Z.table(spark, d, "supplier").select((k % 40).alias("visit"), k.alias("detector"), (150 + (k % 7) * 0.002).alias("ra0"), (2 + (k % 5) * 0.0015).alias("dec0"), F.lit(0.000005).alias("scale"), F.lit(1000).alias("w"), F.lit(800).alias("h"))
    pts = sky(spark, d)[0].select(F.col("src_id").alias("point_id"), (F.col("src_id") % 40).alias("visit"), "ra", "dec")
    return Y.containing(pts, frames).select("point_id", "detector")


@query("j11_pixel_to_sky", "WITH k AS (SELECT p_partkey, ((p_partkey*37) % 4001 - 2000)::DOUBLE AS x, ((p_partkey*91) % 3989 - 1994)::DOUBLE AS y FROM part), m AS (SELECT *, radians(x*0.2/3600) AS xi, radians(y*0.2/3600) AS eta, radians(-35.5) AS d0 FROM k), n AS (SELECT *, sqrt(xi*xi+eta*eta) AS rho FROM m), o AS (SELECT *, atan(rho) AS w FROM n) SELECT p_partkey, round(150.05 + degrees(atan2(xi*sin(w), rho*cos(d0)*cos(w) - eta*sin(d0)*sin(w))),7) AS ra, round(degrees(asin(cos(w)*sin(d0) + CASE WHEN rho > 0 THEN eta*sin(w)*cos(d0)/rho ELSE 0 END)),7) AS dec FROM o")
def j11b(spark, d):
    k = F.col("p_partkey")
    ra, dec = Y.tangent_sky(((k * 37) % 4001 - 2000).cast("double"), ((k * 91) % 3989 - 1994).cast("double"), 150.05, -35.5, 0.2)
    return Z.table(spark, d, "part").select("p_partkey", F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))


@query("j11_sky_to_pixel", f"WITH {SKY_SQL}, k AS (SELECT src_id, radians(ra-150.05) AS a, radians(dec) AS b, radians(2.05) AS d0 FROM pre), m AS (SELECT *, sin(d0)*sin(b)+cos(d0)*cos(b)*cos(a) AS q FROM k) SELECT src_id, round(degrees(1)*3600/0.2*cos(b)*sin(a)/q,4) AS px, round(degrees(1)*3600/0.2*(cos(d0)*sin(b)-sin(d0)*cos(b)*cos(a))/q,4) AS py FROM m")
def j11(spark, d):
    px, py = Y.tangent_pixel(F.col("ra"), F.col("dec"), 150.05, 2.05, 0.2)
    return sky(spark, d)[0].select("src_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


SPANS = "src AS (SELECT p_partkey % 100 + 1 AS image_id, p_partkey AS src_pos, CAST((p_partkey*53) % 128 AS INT) AS y, CAST((p_partkey*29) % 100 AS INT) AS x0, 3 + p_size % 20 AS len FROM part), fpx AS (SELECT image_id, src_pos, y AS r, CAST(x0 + i AS INT) AS c FROM src, range(25) t(i) WHERE i <= len)"


def sources(spark, d):
    k = F.col("p_partkey")
    y, x0 = ((k * 53) % 128).cast("int"), ((k * 29) % 100).cast("int")
    span = F.struct(y.alias("y"), x0.alias("x0"), (x0 + 3 + F.col("p_size") % 20).cast("int").alias("x1"))
    return Z.table(spark, d, "part").select((k % 100 + 1).alias("image_id"), k.alias("src_pos"), F.array(span).alias("spans"))


@query("g06_footprint_raster", f"WITH {SPANS} SELECT image_id, r, c, max(src_pos)+1 AS label FROM fpx GROUP BY 1,2,3")
def g06(spark, d):
    return Y.label_raster(sources(spark, d))


#: Pixels under each object: trails of width 9.
COVER_ALL = """gp AS (SELECT image_id, row_pos, r, c FROM (SELECT image_id, row_pos, x, y, beta, CAST(i AS INT) AS r, CAST(j AS INT) AS c, greatest(-trail_length/2, least(trail_length/2, (j-x)*cos(radians(beta)) + (i-y)*sin(radians(beta)))) AS t
 FROM cat JOIN range(128) a(i) ON i BETWEEN y-trail_length/2-6 AND y+trail_length/2+6 JOIN range(128) b(j) ON j BETWEEN x-trail_length/2-6 AND x+trail_length/2+6) WHERE (c-x - t*cos(radians(beta)))**2 + (r-y - t*sin(radians(beta)))**2 <= 20.250000001)"""


def trails(spark, d):
    return O.trail_pixels(catalog(spark, d), 9.0, Z.SPARSE, Z.SPARSE)


@query("j05_footprint_match", f"WITH {CATALOG_SQL}, {SPANS}, {COVER_ALL}, ar AS (SELECT row_pos, count(*) AS area FROM gp GROUP BY 1), o AS (SELECT row_pos, src_pos, count(*) AS overlap FROM gp JOIN fpx USING (image_id, r, c) GROUP BY 1,2), f AS (SELECT row_pos, min(src_pos) AS src_pos FROM o JOIN ar USING (row_pos) WHERE overlap >= greatest(2, floor(0.02*area)) GROUP BY 1) SELECT cat.row_pos, f.src_pos IS NOT NULL AS stack_detection, f.src_pos, o.overlap FROM cat LEFT JOIN f ON f.row_pos=cat.row_pos LEFT JOIN o ON o.row_pos=f.row_pos AND o.src_pos=f.src_pos")
def j05(spark, d):
    return Y.trail_hits(catalog(spark, d), 9.0, Z.SPARSE, Z.SPARSE, sources(spark, d), 0.02, 2)


@query("f16_forbidden_pixels", f"WITH {SPARSE_SQL}, {SPANS} SELECT image_id, r, c FROM pxs WHERE ((r*31 + c) & 36) <> 0 UNION SELECT image_id, r, c FROM fpx")
def f16(spark, d):
    mask = sparse(spark, d).select("image_id", "r", "c", (F.col("r") * 31 + F.col("c")).alias("mask"))
    return Y.forbidden(mask, [2, 5], Y.label_raster(sources(spark, d)))


@query("j09_overlap_rejection", f"WITH {CATALOG_SQL}, {SPANS}, {COVER_ALL}, k AS (SELECT image_id, row_pos % 10 AS slot, row_pos AS try, r, c FROM gp), bad AS (SELECT DISTINCT image_id, slot, try FROM k JOIN (SELECT DISTINCT image_id, r, c FROM fpx) USING (image_id, r, c)) SELECT image_id, slot, min(try) AS try FROM (SELECT DISTINCT image_id, slot, try FROM k EXCEPT SELECT * FROM bad) GROUP BY 1,2")
def j09(spark, d):
    tries = trails(spark, d).select("image_id", (F.col("row_pos") % 10).alias("slot"), F.col("row_pos").alias("try"), "r", "c")
    return Y.placeable(tries, Y.label_raster(sources(spark, d)))


@query("f17_source_guard", f"WITH {SPANS} SELECT image_id, count(*) AS n, count(*) > 15 AND image_id % 3 <> 0 AS aborted FROM src GROUP BY 1")
def f17(spark, d):
    return K.source_guard(sources(spark, d), 15, F.col("image_id") % 3 == 0)


# Exposures: registry scans, splits, samples and slots

@query("s04_registry_scan", f"{WX}, k AS (SELECT *, row_number() OVER (PARTITION BY visit, detector ORDER BY collection_rank, ref_id) AS n FROM expo WHERE day_obs >= 19940101 AND band IN ('1','2','3')) SELECT visit, detector, ref_id FROM k WHERE n = 1")
def s04(spark, d):
    return R.registry(exposures(spark, d), "day_obs >= 19940101 AND band IN ('1','2','3')").select("visit", "detector", "ref_id")


@query("u05_first_of_key", f"{WX} SELECT visit, detector, min(ref_id) AS ref_id FROM expo GROUP BY 1,2")
def u05(spark, d):
    return exposures(spark, d).groupBy("visit", "detector").agg(F.min("ref_id").alias("ref_id"))


@query("s08_detector_scan", f"{WX}, det AS (SELECT s_suppkey AS detector FROM supplier WHERE s_nationkey % 3 = 0) SELECT ref_id FROM expo SEMI JOIN det USING (detector)")
def s08(spark, d):
    det = Z.table(spark, d, "supplier").filter("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("detector"))
    return exposures(spark, d).join(det, "detector", "left_semi").select("ref_id")


@query("s12_validation_scan", f"{WX} SELECT ref_id FROM expo WHERE valid AND band IS NOT NULL")
def s12(spark, d):
    return R.with_attributes(exposures(spark, d).withColumn("wcs", F.when(F.col("valid"), F.lit(1))), ["wcs", "band"]).select("ref_id")


@query("f10_bad_data_reason", f"{WX} SELECT ref_id, CASE WHEN NOT valid THEN 'wcs_none' WHEN band = '5' THEN 'photocalib_none' END AS reason FROM expo WHERE NOT valid OR band = '5'")
def f10(spark, d):
    e = exposures(spark, d).withColumn("wcs", F.when(F.col("valid"), F.lit(1))).withColumn("photo", F.when(F.col("band") != "5", F.lit(1)))
    return R.bad_reasons(e, {"wcs_none": "wcs", "photocalib_none": "photo"}).select("ref_id", "reason")


@query("f14_key_fallback", f"{WX} SELECT 'column' AS form, ref_id, coalesce(CASE WHEN valid THEN ref_id END, visit) AS exposure FROM expo UNION ALL SELECT 'none', ref_id, visit FROM expo")
def f14(spark, d):
    e = exposures(spark, d)
    both = {"column": e.withColumn("exposure", F.when(F.col("valid"), F.col("ref_id"))), "none": e}
    one = lambda form: R.with_exposure(both[form]).select(F.lit(form).alias("form"), "ref_id", "exposure")
    return one("column").unionByName(one("none"))


@query("f18_batch_limit", f"{WX} SELECT ref_id FROM expo ORDER BY visit, detector, ref_id LIMIT 640")
def f18(spark, d):
    return exposures(spark, d).orderBy("visit", "detector", "ref_id").limit(640).select("ref_id")


@query("a25_modal_each", f"{WX}, s AS (SELECT * FROM expo ORDER BY {order_sql()}, ref_id LIMIT 100) SELECT (SELECT CAST(detector AS DOUBLE) FROM s GROUP BY detector ORDER BY count(*) DESC, detector LIMIT 1) AS detector, (SELECT CAST(collection_rank AS DOUBLE) FROM s GROUP BY collection_rank ORDER BY count(*) DESC, collection_rank LIMIT 1) AS collection_rank")
def a25b(spark, d):
    return S.modal_each(S.first_k(exposures(spark, d), order_key(), "ref_id", 100), ["detector", "collection_rank"])


@query("a25_modal_dimensions", f"{WX} SELECT detector, band, count(*) AS n FROM expo GROUP BY 1,2 ORDER BY n DESC, detector, band LIMIT 1")
def a25(spark, d):
    return S.modal(exposures(spark, d), ["detector", "band"])


ORDERED = f"o AS (SELECT *, {order_sql()} AS k FROM expo)"


@query("t06_shuffled_first_k", f"{WX}, {ORDERED} SELECT ref_id FROM o ORDER BY k, ref_id LIMIT 200")
def t06(spark, d):
    return S.first_k(exposures(spark, d), order_key(), "ref_id", 200).select("ref_id")


@query("t07_filter_until_k", f"{WX}, {ORDERED}, c AS (SELECT * FROM o ORDER BY k, ref_id LIMIT 3000) SELECT ref_id FROM c WHERE valid AND band = '1' ORDER BY k, ref_id LIMIT 150")
def t07(spark, d):
    return S.filter_until(exposures(spark, d), order_key(), "ref_id", F.expr("valid and band = '1'"), 150, 3000).select("ref_id")


@query("t08_sample_without_replacement", f"{WX} SELECT ref_id FROM (SELECT ref_id FROM expo ORDER BY {order_sql(seed=5)}, ref_id LIMIT 500)")
def t08(spark, d):
    return S.first_k(exposures(spark, d), order_key(seed=5), "ref_id", 500).select("ref_id")


@query("t09_reservoir", f"{WX} SELECT ref_id FROM expo ORDER BY {order_sql(seed=123)}, ref_id LIMIT 100")
def t09(spark, d):
    return S.first_k(exposures(spark, d), order_key(seed=123), "ref_id", 100).select("ref_id")


@query("t10_debug_subset", f"{WX} SELECT ref_id FROM expo ORDER BY {order_sql(seed=9)}, ref_id LIMIT 64")
def t10(spark, d):
    return S.first_k(exposures(spark, d), order_key(seed=9), "ref_id", 64).select("ref_id")


@query("t11_target_count", f"{WX} SELECT least(50000, count(*)) AS target FROM expo")
def t11(spark, d):
    return exposures(spark, d).agg(F.least(F.lit(50000).cast("long"), F.count("*")).alias("target"))


@query("u07_random_split", f"{WX}, {ORDERED}, n AS (SELECT ref_id, row_number() OVER (ORDER BY k, ref_id) - 1 AS i FROM o) SELECT ref_id, CASE WHEN i < CAST(floor(0.9*(SELECT count(*) FROM o)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM n")
def u07(spark, d):
    return S.split(exposures(spark, d), order_key(), "ref_id", 0.9).select("ref_id", "split")


@query("u08_positional_split", f"{WE}, n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i FROM eph) SELECT event_id, CASE WHEN i <= round_even((SELECT count(*) FROM eph)*0.85, 0) THEN 'train' ELSE 'test' END AS split FROM n")
def u08(spark, d):
    return S.split(ephemerides(spark, d), F.col("event_id"), "event_id", 0.85, "rint").select("event_id", "split")


@query("u09_ordinal_split", f"{WX}, n AS (SELECT ref_id, row_number() OVER (ORDER BY {order_sql(seed=3)}, ref_id) - 1 AS i FROM expo) SELECT ref_id, CASE WHEN i < CAST(floor(0.94117*(SELECT count(*) FROM expo)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM n")
def u09(spark, d):
    return S.split(exposures(spark, d), order_key(seed=3), "ref_id", 0.94117).select("ref_id", "split")


@query("o03_fill_slots", f"{WX}, {ORDERED}, n AS (SELECT *, row_number() OVER (ORDER BY k, ref_id) - 1 AS i FROM o) SELECT CAST(i % 300 AS INT) AS slot, arg_min(ref_id, i) AS ref_id, min(i) AS rank FROM n WHERE valid AND band IN ('1','2') GROUP BY 1")
def o03(spark, d):
    return S.fill_slots(exposures(spark, d), order_key(), "ref_id", F.expr("valid and band in ('1','2')"), 300)


@query("d02_mixture_sampler", f"""{WX}, b AS (SELECT band AS bucket, ref_id, row_number() OVER (PARTITION BY band ORDER BY ref_id) - 1 AS k FROM expo), s AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1), dr AS (SELECT '1' AS bucket, i FROM range(500) t(i) UNION ALL SELECT '2', i FROM range(300) t(i) UNION ALL SELECT '3', i FROM range(200) t(i))
 SELECT bucket, i AS draw, ref_id FROM dr JOIN s USING (bucket) JOIN b USING (bucket) WHERE k = ((i*7919 + 7*104729 + 2*1299709) * 2654435761) % 4294967296 % n""")
def d02(spark, d):
    counts = S.mixture_counts({"1": 1, "2": 1, "3": 1}, {"1": 0.5, "2": 0.3, "3": 0.2}, 1000, "3")
    return S.mixture(exposures(spark, d), "ref_id", "band", counts, 7, 2)


@query("d03_cycling_sampler", f"{WC}, n AS (SELECT row_pos, row_number() OVER (ORDER BY row_pos) - 1 AS k, count(*) OVER () AS n FROM cat) SELECT i, row_pos FROM range(5000) t(i) JOIN n ON k = i % n")
def d03(spark, d):
    return S.cycle(catalog(spark, d), "row_pos", 5000)


@query("t01_multi_key_sort", f"{WE} SELECT FieldID, ObjID, event_id FROM eph ORDER BY FieldID, ObjID, RA_deg, Dec_deg")
def t01(spark, d):
    return ephemerides(spark, d).orderBy("FieldID", "ObjID", "RA_deg", "Dec_deg").select("FieldID", "ObjID", "event_id")


TIMING_SQL = """WITH a AS (SELECT l_linenumber AS worker, l_orderkey AS rank, l_returnflag <> 'R' AS ok, l_quantity/10 AS c, l_discount AS s, l_tax AS w, l_extendedprice/100 AS rss FROM lineitem),
 o AS (SELECT worker, CAST(floor(rank/2500) AS BIGINT) AS step, count(*) AS n, count(*) FILTER (ok) AS good, sum(c) AS c, sum(s) FILTER (ok) AS s, sum(w) FILTER (ok) AS w, max(rss) AS rss FROM a GROUP BY 1,2)
 SELECT worker, step, CAST(sum(n) OVER u AS BIGINT) AS attempts, CAST(sum(good) OVER u AS BIGINT) AS successes, round(sum(c) OVER u/sum(n) OVER u,6) AS compute_s, round(sum(s) OVER u/nullif(sum(good) OVER u,0),6) AS stage_s, round(sum(w) OVER u/nullif(sum(good) OVER u,0),6) AS write_s, round(max(rss) OVER u,6) AS rss_mb FROM o WINDOW u AS (PARTITION BY worker ORDER BY step ROWS UNBOUNDED PRECEDING)"""


@query("a36_run_timing", TIMING_SQL)
def a36(spark, d):
    t = Z.table(spark, d, "lineitem")
    attempts = t.select(F.col("l_linenumber").alias("worker"), F.col("l_orderkey").alias("rank"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_quantity") / 10).alias("compute_s"), F.col("l_discount").alias("stage_s"), F.col("l_tax").alias("write_s"), (F.col("l_extendedprice") / 100).alias("rss_mb"))
    return rounded(K.run_timing(attempts, "worker", 2500))


@query("k06_columns_by_prefix", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def k06(spark, d):
    return R.columns_by_prefix(Z.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_part", "l_supp"])


@query("o06_failed_rows", f"{WX} SELECT ref_id, CASE WHEN valid THEN day_obs ELSE 0 END AS day_obs FROM expo")
def o06(spark, d):
    e = exposures(spark, d)
    return e.select("ref_id").join(e.filter("valid").select("ref_id", "day_obs"), "ref_id", "left").select("ref_id", F.coalesce("day_obs", F.lit(0)).alias("day_obs"))


@query("o05_errors_as_rows", "SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS value, CASE WHEN TRY_CAST(event_type AS DOUBLE) IS NULL THEN 'cast_fail' END AS error FROM events")
def o05(spark, d):
    v = F.expr("try_cast(event_type as double)")
    return Z.table(spark, d, "events").select("event_id", v.alias("value"), F.when(v.isNull(), "cast_fail").alias("error"))


# Sources and sinks: written to the folder that executors share, and read back

@query("s03_catalog_csv", f"{WC} SELECT image_id, row_pos AS injection_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, beta, trail_length, round(SNR,6) AS SNR, stack_detection, round(stack_mag,6) AS stack_mag FROM cat")
def s03(spark, d):
    cat = catalog(spark, d).withColumnRenamed("row_pos", "injection_id")
    path = R.scratch(spark)
    R.write_csv(cat, path, R.CATALOG)
    return rounded(R.read_csv(spark, path, R.CATALOG).select("image_id", "injection_id", "x", "y", "beta", "trail_length", "SNR", "stack_detection", "stack_mag"))


@query("k04_csv_append", f"{WE} SELECT event_id, FieldID, ObjID, round(RA_deg,6) AS RA_deg, CAST(n AS INT) AS part FROM eph, range(2) t(n) WHERE n = 0 OR event_id % 3 = 0")
def k04(spark, d):
    path = R.scratch(spark)
    rows = ephemerides(spark, d).select("event_id", "FieldID", "ObjID", "RA_deg")
    for n in (0, 1, 2):  # the last part is empty, and leaves the file as it is
        R.append_csv(rows.withColumn("part", F.lit(n)).filter("part = 0 or (part = 1 and event_id % 3 = 0)"), path)
    return rounded(R.read_csv(spark, path, "event_id BIGINT, FieldID BIGINT, ObjID STRING, RA_deg DOUBLE, part INT"))


@query("k05_bad_visits", f"{WX} SELECT visit, CAST(detector AS INT) AS detector, CASE WHEN NOT valid THEN 'wcs_none' ELSE 'photocalib_none' END AS reason FROM expo WHERE NOT valid OR band = '5'")
def k05(spark, d):
    e = exposures(spark, d).withColumn("wcs", F.when(F.col("valid"), F.lit(1))).withColumn("photo", F.when(F.col("band") != "5", F.lit(1)))
    path = R.scratch(spark)
    R.write_csv(R.bad_reasons(e, {"wcs_none": "wcs", "photocalib_none": "photo"}), path, R.BAD_VISITS)
    return R.read_csv(spark, path, R.BAD_VISITS)


@query("k01_image_sink", f"WITH {DENSE_SQL} SELECT CASE WHEN image_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, image_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(gt::INT) AS BIGINT) AS masks, CAST(sum(real) AS BIGINT) AS reals, round(sum(flux),5) AS flux FROM px8 GROUP BY 1,2")
def k01(spark, d):
    path = R.scratch(spark)
    R.write_images(dense(spark, d).withColumn("split", F.when(F.col("image_id") % 5 == 0, "test").otherwise("train")), path)
    cube = R.read_images(spark, path)
    return cube.groupBy("split", "image_id").agg(F.count("*").alias("n"), F.sum(F.col("gt").cast("int")).alias("masks"), F.sum("real").alias("reals"), F.round(F.sum("flux"), 5).alias("flux"))


@query("o05_timeouts", "SELECT event_id, CASE WHEN event_id % 250 = 1 OR user_id % 7 = 0 THEN NULL ELSE round(100.0/(user_id % 7),6) END AS value, CASE WHEN event_id % 250 = 1 THEN 'timeout' WHEN user_id % 7 = 0 THEN 'ZeroDivisionError' END AS error FROM events")
def o05b(spark, d):
    def work(row):
        while row["event_id"] % 250 == 1:  # never ends by itself
            pass
        return 100.0 / (row["user_id"] % 7)

    return rounded(K.guarded(Z.table(spark, d, "events").select("event_id", "user_id"), "event_id", work, 0.5))


WRONG = ["threshold must be from 0 to 1", "topk_fraction must be over 0 and at most 1", "score_method is unknown"]


@query("x25_config_check", "SELECT CAST(i AS INT) AS i, said FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(WRONG)) + ") v(i, said)")
def x25(spark, d):
    from lumenframe.functions.config import Config, Detection

    try:
        Config(detection=Detection(threshold=1.5, topk_fraction=0.0, score_method="none")).validate()
        said = []
    except ValueError as e:
        said = str(e).split("; ")
    return spark.createDataFrame(list(enumerate(said)), "i int, said string")
