"""Histograms and completeness of catalogs, and weighted sums over stamps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.pixels import count_if


def finite(field: str, lo: float | None = None, hi: float | None = None) -> Column:
    v = F.col(field)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    return ok & v.between(lo, hi) if lo is not None else ok


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bins; the last one holds its upper edge."""
    width = (hi - lo) / bins
    return F.when(width > 0, F.least(F.floor((v - lo) / width), F.lit(bins - 1))).otherwise(0).cast("int")


def detection_histogram(catalog: DataFrame, field: str, bins: int = 12, xlim: tuple[float, float] | None = None, nn: str = "nn_detected", stack: str = "stack_detection") -> DataFrame:
    """Counts of all objects and of those that each detector has, with ratios; edges come from the filtered data."""
    rows = catalog.filter(finite(field, *xlim) if xlim else finite(field))
    edges = rows.agg(F.min(field).alias("_lo"), F.max(field).alias("_hi"))
    a, b = F.coalesce(F.col(nn), F.lit(False)), F.coalesce(F.col(stack), F.lit(False))
    binned = rows.join(F.broadcast(edges)).withColumn("bin", bin_of(F.col(field), F.col("_lo"), F.col("_hi"), bins))
    out = binned.groupBy("bin").agg(F.count("*").alias("n"), count_if(a).alias("nn"), count_if(b).alias("stack"), count_if(a | b).alias("either"), count_if(a & ~b).alias("nn_only"))
    return out.withColumn("completeness", F.try_divide("either", "n"))


def completeness_2d(catalog: DataFrame, x: str, y: str, nx: int, ny: int, xr: tuple[float, float], yr: tuple[float, float], detected: Column) -> DataFrame:
    """bin_x, bin_y, total, detected, ratio for every cell; 0 where a cell is empty."""
    rows = catalog.filter(finite(x, *xr) & finite(y, *yr))
    cells = rows.groupBy(bin_of(F.col(x), F.lit(xr[0]), F.lit(xr[1]), nx).alias("bin_x"), bin_of(F.col(y), F.lit(yr[0]), F.lit(yr[1]), ny).alias("bin_y")).agg(F.count("*").alias("total"), count_if(F.coalesce(detected, F.lit(False))).alias("detected"))
    grid = catalog.sparkSession.range(nx * ny).select(F.floor(F.col("id") / ny).cast("int").alias("bin_x"), (F.col("id") % ny).cast("int").alias("bin_y"))
    out = grid.join(cells, ["bin_x", "bin_y"], "left").na.fill(0, ["total", "detected"])
    return out.withColumn("ratio", F.coalesce(F.try_divide("detected", "total"), F.lit(0.0)))


def centroid(stamps: DataFrame, value: str = "phi") -> DataFrame:
    """cx, cy weighted by the values, negatives as 0; the geometric centre where there is no weight."""
    w = F.greatest(F.col(value), F.lit(0.0))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * w), F.sum(w)), (F.max(c) + F.min(c)) / 2)
    return stamps.groupBy("image_id").agg(mean("c").alias("cx"), mean("r").alias("cy"))


def moment_sigma(stamps: DataFrame, value: str = "phi") -> DataFrame:
    """sqrt of half the summed second moments about the centroid; null without positive weight."""
    w = F.greatest(F.col(value), F.lit(0.0))
    about = stamps.join(centroid(stamps, value), "image_id")
    d2 = (F.col("c") - F.col("cx")) ** 2 + (F.col("r") - F.col("cy")) ** 2
    return about.groupBy("image_id").agg(F.sqrt(F.try_divide(F.sum(d2 * w), F.sum(w)) / 2).alias("sigma"))


def flux_sigma(stamps: DataFrame, phi: str, template: str, var: str) -> DataFrame:
    """sqrt(sum phi^2 / V) / sum(phi T / V) over pixels with finite positive variance."""
    p, t, v = F.col(phi), F.col(template), F.col(var)
    good = stamps.filter(v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < F.lit(math.inf)))
    return good.groupBy("image_id").agg(F.try_divide(F.sqrt(F.sum(p * p / v)), F.sum(p * t / v)).alias("sigma_f"))


def local_depth(stamps: DataFrame, phi: str, var: str, snr: float = 5.0, zero: float = 31.4) -> DataFrame:
    """The magnitude at snr times sqrt(sum phi^2 V) / sum phi^2."""
    p, v = F.col(phi), F.col(var)
    sigma = F.sqrt(F.sum(p * p * v)) / F.sum(p * p)
    return stamps.groupBy("image_id").agg((F.lit(zero) - 2.5 * F.log10(snr * sigma)).alias("m5"))
