"""Pixel metrics: confusion counts, binned sweeps, curves over pixels, statistics and losses.

Pixel frames hold image_id, r, c, p (a probability), gt (truth) and real (label of an existing source).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_score(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    return ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def scores(tp: str, fp: str, fn: str, prefix: str = "") -> list[Column]:
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return [ratio(t, t + p).alias(f"{prefix}precision"), ratio(t, t + n).alias(f"{prefix}recall"), f_score(t, p, n, 1).alias(f"{prefix}f1"), f_score(t, p, n, 2).alias(f"{prefix}f2")]


def valid(px: DataFrame) -> DataFrame:
    """Without pixels of existing sources."""
    return px.filter(~(F.coalesce(F.col("real"), F.lit(0)) > 0.5))


def confusion(px: DataFrame, threshold: float) -> DataFrame:
    """Exact counts at one threshold."""
    hit = F.col("p") >= threshold
    return px.agg(count_if(hit & F.col("gt")).alias("tp"), count_if(hit & ~F.col("gt")).alias("fp"), count_if(~hit & F.col("gt")).alias("fn"), count_if(~hit & ~F.col("gt")).alias("tn"))


def histogram(px: DataFrame, bin_: Column) -> DataFrame:
    """bin, pos, neg: positives and negatives of each bin, partially aggregated before the shuffle."""
    return px.groupBy(bin_.alias("bin")).agg(count_if(F.col("gt")).alias("pos"), count_if(~F.col("gt")).alias("neg"))


def sweep_bin(nbins: int) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    return F.floor(p * (nbins - 1)).cast("int")


def auc_bin(nbins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(nbins - 1), F.floor(F.col("p") * nbins).cast("int")))


def from_top(h: DataFrame) -> DataFrame:
    """Adds tp and fp: positives and negatives in this bin or a higher one, and the totals P and N.

    h is a histogram, so its size is bounded by the number of bins.
    """
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return h.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).withColumn("P", F.sum("pos").over(whole)).withColumn("N", F.sum("neg").over(whole))


def thresholds(df: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """thr_idx, thr: n evenly spaced thresholds."""
    t = df.sparkSession.range(n).select(F.col("id").cast("int").alias("thr_idx"))
    return t.withColumn("thr", F.round(lo + (hi - lo) * F.col("thr_idx") / max(1, n - 1), 9))


def sweep(px: DataFrame, n: int = 51, lo: float = 0.0, hi: float = 1.0, nbins: int = 4096) -> DataFrame:
    """Counts and scores at n thresholds from one histogram: bins at or above the threshold's bin count."""
    h = histogram(px, sweep_bin(nbins))
    t = thresholds(px, lo, hi, n).withColumn("tbin", F.floor(F.col("thr") * (nbins - 1)).cast("int"))
    total = h.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # Both sides are small: bins x thresholds.
    at = t.join(F.broadcast(h), F.col("bin") >= F.col("tbin"), "left").groupBy("thr_idx", "thr").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    out = at.join(F.broadcast(total)).select("thr_idx", "thr", F.col("tp").alias("pix_tp"), F.col("fp").alias("pix_fp"), (F.col("P") - F.col("tp")).alias("pix_fn"), (F.col("N") - F.col("fp")).alias("pix_tn"))
    return out.select("*", *scores("pix_tp", "pix_fp", "pix_fn", "pix_"))


def histogram_auc(px: DataFrame, nbins: int = 256, anchored: bool = False, empty: float | None = None) -> DataFrame:
    """One row `auc` by the trapezoid rule over bins; `empty` where a class has no pixel.

    anchored adds (0,0) and (1,1) and guards denominators by 1e-12.
    """
    curve = from_top(histogram(px, auc_bin(nbins)))
    guard = 1e-12 if anchored else 0.0
    tpr, fpr = F.try_divide(F.col("tp"), F.col("P") + guard), F.try_divide(F.col("fp"), F.col("N") + guard)
    points = curve.select((-F.col("bin")).alias("o"), fpr.alias("x"), tpr.alias("y"), "P", "N")
    if anchored:
        ends = curve.select("P", "N").limit(1)
        points = points.unionByName(ends.select(F.lit(-nbins - 1).alias("o"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "P", "N")).unionByName(ends.select(F.lit(1).alias("o"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), "P", "N"))
    area = trapezoid(points, "x", "y", "o", keep=["P", "N"])
    missing = (F.coalesce("P", F.lit(0)) <= 0) | (F.coalesce("N", F.lit(0)) <= 0)
    return area.select(F.when(missing, F.lit(empty).cast("double")).otherwise(F.col("area")).alias("auc"))


def trapezoid(points: DataFrame, x: str, y: str, order: str, keep: list[str] | None = None) -> DataFrame:
    """One row `area`: the integral of y over x in the given order of a small curve."""
    w = Window.orderBy(order)
    dx, my = F.col(x) - F.lag(x).over(w), (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("_a", dx * my).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"), *[F.max(k).alias(k) for k in keep or []])


def histogram_auc_by(px: DataFrame, by: str, nbins: int = 256) -> DataFrame:
    """by, auc: the area of each group by the trapezoid rule over bins; null where a class has no pixel."""
    h = px.groupBy(by, auc_bin(nbins).alias("bin")).agg(count_if(F.col("gt")).alias("pos"), count_if(~F.col("gt")).alias("neg"))
    down, whole = Window.partitionBy(by).orderBy(F.desc("bin")), Window.partitionBy(by)
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    c = h.select(by, "bin", F.sum("pos").over(upto).alias("tp"), F.sum("neg").over(upto).alias("fp"), F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    c = c.withColumn("x", F.try_divide("fp", "N")).withColumn("y", F.try_divide("tp", "P"))
    part = (F.col("x") - F.lag("x").over(down)) * (F.col("y") + F.lag("y").over(down)) / 2
    return c.withColumn("_a", part).groupBy(by).agg(F.when((F.min("P") > 0) & (F.min("N") > 0), F.coalesce(F.sum("_a"), F.lit(0.0))).alias("auc"))


def panels_with_positives(px: DataFrame, positive: Column, max_panels: int | None = None, order: Column | None = None) -> DataFrame:
    """image_id of images with a positive pixel, of all images or of the first max_panels in the given order."""
    if max_panels is not None:
        first = px.select("image_id").distinct().orderBy(order, "image_id").limit(max_panels)
        px = px.join(first, "image_id", "left_semi")
    return px.groupBy("image_id").agg(F.bool_or(positive).alias("_any")).filter("_any").select("image_id")


def mask_counts(px: DataFrame) -> DataFrame:
    ok = ~(F.coalesce(F.col("real"), F.lit(0)) > 0.5)
    gt = F.col("gt")
    return px.agg(count_if(gt & ok).alias("pos_valid"), count_if(~gt & ok).alias("neg_valid"), count_if(gt).alias("pos_all"), count_if(~gt).alias("neg_all"))


def similarity(px: DataFrame) -> DataFrame:
    """Of two binary masks: rate of equal pixels, intersection over union, correlation, sums."""
    a, b = F.col("gt").cast("double"), (F.coalesce(F.col("real"), F.lit(0)) > 0.5).cast("double")
    both = F.sum(a * b)
    return px.agg(F.avg((a == b).cast("double")).alias("equal_rate"), ratio(both, F.sum(a) + F.sum(b) - both).alias("iou"), F.corr(a, b).alias("pearson"), F.sum(a).cast("long").alias("sum_y"), F.sum(b).cast("long").alias("sum_real"))


def median_by(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """by and the exact median, the mean of the middle two: groups are sorted, which spills, and not held in a buffer."""
    rows = df.select(by, value.alias("_v"))
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_v")) - 1).join(n, by)
    middle = F.col("_k").between(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    return ranked.filter(middle).groupBy(by).agg(F.avg("_v").alias(name))


def robust_stats(px: DataFrame, value: str = "flux", by: str = "image_id") -> DataFrame:
    """med and sigma = 1.4826 * (MAD + 1e-12) of each image; 0 and 1 where they aren't finite or positive."""
    fine = px.filter(F.col(value).isNotNull() & ~F.isnan(value))
    med = median_by(fine, by, F.col(value), "_m")
    mad = median_by(fine.join(med, by), by, F.abs(F.col(value) - F.col("_m")), "_d").join(med, by)
    sigma = 1.4826 * (F.col("_d") + 1e-12)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return mad.select(by, F.when(finite(F.col("_m")), F.col("_m")).otherwise(0.0).alias("med"), F.when(finite(sigma) & (sigma > 0), sigma).otherwise(1.0).alias("sigma"))


#: Bins of a pass of ranked_value(), and values that its last step sorts.
RANK_BINS, RANK_ROWS = 4096, 100_000


def ranked_value(df: DataFrame, value: Column, rank: Callable[[int], int]) -> float | None:
    """The value of rank(n), from 0, in order of all n values that are numbers.

    Each pass counts bins between two bounds and keeps the bin that holds the rank, until few values are left.
    """
    rows = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')")
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    k = rank(n)
    while lo < hi and n > RANK_ROWS:
        width = (hi - lo) / RANK_BINS
        at = F.least(F.lit(RANK_BINS - 1), F.floor((F.col("v") - lo) / width)) if width > 0 else F.when(F.col("v") > lo, 1).otherwise(0)
        bins = rows.filter(F.col("v").between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()  # RANK_BINS rows
        for b in bins:
            if k < b["n"]:
                n, lo, hi = b["n"], b["lo"], b["hi"]
                break
            k -= b["n"]
    if lo == hi:
        return lo
    return rows.filter(F.col("v").between(lo, hi)).orderBy("v").limit(k + 1).agg(F.max("v")).first()[0]


def centre_crop(px: DataFrame, h: int, w: int, side: int) -> DataFrame:
    """The centred square of side min(side, h, w)."""
    s = min(side, h, w)
    r0, c0 = (h - s) // 2, (w - s) // 2
    return px.filter(F.col("r").between(r0, r0 + s - 1) & F.col("c").between(c0, c0 + s - 1))


def normalise(px: DataFrame, stats: DataFrame, clip: float = 5.0, value: str = "flux") -> DataFrame:
    z = (F.col(value) - F.col("med")) / F.col("sigma")
    return px.join(stats, "image_id").withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("med", "sigma")


def lower_median(value: Column | str) -> Column:
    return F.percentile_disc(value, 0.5) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.5) within group (order by {value})")


def row_median_stats(px: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Lower median of the rows' lower medians for each image, and one pooled 1.4826 * MAD + eps."""
    rows = px.groupBy("image_id", "r").agg(F.expr("percentile_disc(0.5) within group (order by flux)").alias("m"))
    med = rows.groupBy("image_id").agg(F.expr("percentile_disc(0.5) within group (order by m)").alias("med"))
    spread = ranked_value(px.join(med, "image_id"), F.abs(F.col("flux") - F.col("med")), lambda n: (n - 1) // 2)
    return med.withColumn("sigma", F.lit(None if spread is None else spread * 1.4826 + eps).cast("double"))


def sobel_l1(px: DataFrame, value: str = "p") -> DataFrame:
    """gx, gy of 3x3 Sobel stencils with zeros outside the image, one row a pixel."""
    offsets = [(dr, dc, gx, gy) for dr, row in zip((-1, 0, 1), ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)), strict=True) for dc, gx, gy in zip((-1, 0, 1), row, ((-1, -2, -1), (0, 0, 0), (1, 2, 1))[dr + 1], strict=True)]
    s = F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(gx).alias("gx"), F.lit(gy).alias("gy")) for dr, dc, gx, gy in offsets])
    sent = px.withColumn("s", F.explode(s)).select("image_id", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), (F.col(value) * F.col("s.gx")).alias("x"), (F.col(value) * F.col("s.gy")).alias("y"), ((F.col("s.dr") == 0) & (F.col("s.dc") == 0)).alias("own"))
    return sent.groupBy("image_id", "r", "c").agg(F.sum("x").alias("gx"), F.sum("y").alias("gy"), F.bool_or("own").alias("own")).filter("own").drop("own")


def dilate(px: DataFrame, g: int) -> DataFrame:
    """image_id, r, c of all pixels within Chebyshev distance g of one in px."""
    step = F.sequence(F.lit(-g), F.lit(g))
    rows = px.select("image_id", F.explode(F.transform(step, lambda d: F.col("r") + d)).alias("r"), "c")
    return rows.select("image_id", "r", F.explode(F.transform(step, lambda d: F.col("c") + d)).alias("c")).distinct()


def soft_iou_loss(px: DataFrame, eps: float = 1e-6) -> DataFrame:
    p, t = F.col("p"), F.col("gt").cast("double")
    each = px.groupBy("image_id").agg((1 - F.sum(p * t) / (F.sum(p + t - p * t) + eps)).alias("loss"))
    return each.agg(F.avg("loss").alias("loss"))


def focal_tversky(px: DataFrame, alpha: float = 0.45, beta: float = 0.55, gamma: float = 1.3, eps: float = 1e-6) -> DataFrame:
    p, t = F.col("p"), F.col("gt").cast("double")
    tp, fp, fn = F.sum(p * t), F.sum(p * (1 - t)), F.sum((1 - p) * t)
    each = px.groupBy("image_id").agg(F.pow(1 - (tp + eps) / (tp + alpha * fp + beta * fn + eps), F.lit(gamma)).alias("loss"))
    return each.agg(F.avg("loss").alias("loss"))


def bce_with_logits(logit: Column, target: Column, pos_weight: float) -> Column:
    """The stable form of weighted binary cross entropy."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    return pos_weight * target * (F.greatest(-logit, F.lit(0.0)) + soft) + (1 - target) * (F.greatest(logit, F.lit(0.0)) + soft)


def masked_bce(px: DataFrame, logit: Column, pos_weight: float) -> DataFrame:
    v = (~(F.coalesce(F.col("real"), F.lit(0)) > 0.5)).cast("double")
    loss = bce_with_logits(logit, F.col("gt").cast("double"), pos_weight)
    return px.agg((F.sum(loss * v) / F.greatest(F.sum(v), F.lit(1.0))).alias("loss"))
