"""Curves over a small frame of thresholds: ROC, FROC, partial areas, best thresholds, running folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.pixels import ratio, trapezoid

#: Consecutive orders that one task looks at.
RANGE = 4096


def roc(sweep: DataFrame, tp: str = "pix_tp", fp: str = "pix_fp", tn: str = "pix_tn", fn: str = "pix_fn", order: str = "thr_idx") -> DataFrame:
    """order_idx, fpr, tpr, pos: points in stable order of fpr; 0 where a denominator is 0."""
    pts = sweep.select(F.col(order).alias("order_idx"), ratio(F.col(fp), F.col(fp) + F.col(tn)).alias("fpr"), ratio(F.col(tp), F.col(tp) + F.col(fn)).alias("tpr"))
    return pts.withColumn("pos", F.row_number().over(Window.orderBy("fpr", "order_idx")))


def froc(sweep: DataFrame, n_images: int, tp: str = "obj_tp", fp: str = "obj_fp", fn: str = "obj_fn", order: str = "thr_idx") -> DataFrame:
    """thr, fppi, recall, and recall made monotone in order of fppi."""
    if n_images <= 0:
        raise ValueError("the number of images must be positive")
    pts = sweep.select(order, "thr", (F.col(fp) / F.lit(n_images)).alias("fppi"), ratio(F.col(tp), F.col(tp) + F.col(fn)).alias("recall"))
    up = Window.orderBy("fppi", order).rowsBetween(Window.unboundedPreceding, 0)
    return pts.withColumn("recall_plot", F.max("recall").over(up))


def partial_auc(points: DataFrame, x_max: float | None = None, normalize: bool = False) -> DataFrame:
    """One row `area` of the curve (pos, fpr, tpr) up to x_max, by default its largest fpr.

    (0,0) comes first if the curve starts later.  If the points up to x_max end before it, one at x_max
    follows: interpolated towards the next point, or as high as the last one where there is none.
    """
    limit = F.lit(float(x_max)) if x_max is not None else F.lit(points.agg(F.max("fpr")).first()[0]).cast("double")
    inside = points.filter(F.col("fpr") <= limit).select("pos", "fpr", "tpr")
    first, last = (lambda c: F.min_by(c, F.struct("fpr", "pos"))), (lambda c: F.max_by(c, F.struct("fpr", "pos")))
    below = F.col("fpr") <= limit
    ends = points.agg(
        F.min("fpr").alias("x0"), first("tpr").alias("y0"), F.count_if(below).alias("n"),
        F.max_by(F.when(below, F.col("fpr")), F.when(below, F.col("pos"))).alias("xa"), F.max_by(F.when(below, F.col("tpr")), F.when(below, F.col("pos"))).alias("ya"), F.max(F.when(below, F.col("pos"))).alias("pa"),
        F.min_by(F.when(~below, F.col("fpr")), F.when(~below, F.col("pos"))).alias("xb"), F.min_by(F.when(~below, F.col("tpr")), F.when(~below, F.col("pos"))).alias("yb"), last("tpr").alias("y9"),
    )
    start = ends.filter("x0 > 0").select(F.lit(0).alias("pos"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    height = F.when(F.col("n") == 0, F.col("y0")).when(F.col("xb").isNull(), F.col("y9")).otherwise(F.col("ya") + (F.col("yb") - F.col("ya")) * (limit - F.col("xa")) / (F.col("xb") - F.col("xa")))
    end = ends.filter((F.col("n") == 0) | (F.col("xa") < limit)).filter(F.col("x0").isNotNull()).select((F.coalesce("pa", F.lit(0)) + 1).alias("pos"), limit.alias("fpr"), height.alias("tpr"))
    area = trapezoid(inside.unionByName(start).unionByName(end), "fpr", "tpr", "pos").select(F.when(limit > 0, F.col("area")).otherwise(0.0).alias("area"))
    return area.select((F.coalesce(F.try_divide(F.col("area"), limit), F.lit(0.0)) if normalize else F.col("area")).alias("area"))


def best_threshold(sweep: DataFrame, score: str = "obj_f2", order: str = "thr_idx") -> DataFrame:
    """The first threshold with the largest score."""
    return sweep.agg(F.max_by("thr", F.struct(F.col(score), -F.col(order))).alias("thr"), F.max(score).alias("score"))


def running_best(epochs: DataFrame, value: str, order: str) -> DataFrame:
    """Adds `best` (so far) and `improved`: strictly better than everything before.

    The orders, integers, are cut into ranges; each starts from the best of all lower ones.
    """
    rows = epochs.withColumn("_b", F.floor(F.col(order) / RANGE))
    tops = rows.groupBy("_b").agg(F.max(value).alias("_top"))
    base = tops.select("_b", F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    inside = Window.partitionBy("_b").orderBy(order)
    before = F.greatest(F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_base"))
    out = rows.join(base, "_b").withColumn("_before", before)
    return out.withColumn("improved", F.coalesce(F.col(value) > F.col("_before"), F.lit(True))).withColumn("best", F.greatest(F.col(value), F.col("_before"))).drop("_b", "_base", "_before")


def moving_average(df: DataFrame, by: str, order: str, value: str, decay: float) -> DataFrame:
    """by, ema: s <- decay * s + (1 - decay) * x over the ordered values of a group, from its first."""
    xs = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    fold = F.aggregate(F.slice(F.col("xs"), 2, F.size("xs")), F.element_at("xs", 1), lambda s, x: decay * s + (1 - decay) * x)
    return df.groupBy(by).agg(xs.alias("xs")).select(by, fold.alias("ema"))
