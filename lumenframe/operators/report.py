"""The whole metric report: a sweep, its curves, the best threshold, and what holds there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import curves as C
from lumenframe.operators import histograms as H
from lumenframe.operators import objects as O
from lumenframe.operators.components import label_components
from lumenframe.operators.pixels import trapezoid

BINS = 12
GRID = 10


def long(df: DataFrame, section: str, names: list[str], i: str | None = None, j: str | None = None) -> DataFrame:
    """section, name, i, j, value: a row for each named column of each row."""
    at = lambda c: (F.lit(0) if c is None else F.col(c)).cast("int")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(section).alias("section"), at(i).alias("i"), at(j).alias("j"), F.explode(pairs).alias("p")).select("section", "p.name", "i", "j", "p.value")


def metric_report(objects: DataFrame, px: DataFrame, width: float, gap: int, stack_px: DataFrame, n_images: int, n: int = 51, best: float | None = None) -> DataFrame:
    """section, name, i, j, value: sweep, ROC and FROC, the threshold with the best object F2 (or a given one), and there
    object and pixel confusion, both detectors combined, detection histograms and two-dimensional completeness.

    px has gt; objects have SNR, trail_length and a baseline detector's flag.
    """
    scan = O.threshold_scan(objects, px, width, gap, n, stack_px=stack_px)
    scan = scan.sparkSession.createDataFrame(scan.collect(), scan.schema)  # n rows
    roc = C.roc(scan)
    sections = [
        long(scan, "sweep", [c for c in scan.columns if c != "thr_idx"], "thr_idx"),
        long(roc, "roc", ["fpr", "tpr"], "pos"),
        long(trapezoid(roc, "fpr", "tpr", "pos").select(F.col("area").alias("roc")), "area", ["roc"]),
        long(C.froc(scan, n_images), "froc", ["fppi", "recall", "recall_plot"], "thr_idx"),
    ]
    if best is None:
        top = C.best_threshold(scan.withColumn("obj_f2", F.round("obj_f2", 6)))
        sections.append(long(top.withColumnRenamed("score", "obj_f2"), "best", ["thr", "obj_f2"]))
        best = top.first()["thr"]
    labelled = label_components(O.of_objects(px.filter(F.col("p") >= best).select("image_id", "r", "c", "p"), objects), gap)
    found = O.match(objects, O.edges(objects, labelled, width))
    full = O.full_confusion(objects, px, labelled, width, best, stack_px)
    sections.append(long(full, "confusion", full.columns))
    sections.append(long(O.combined(objects, labelled, width, stack_px), "combined", ["tp", "fn", "fp"]))
    for column in ("SNR", "trail_length"):
        h = H.detection_histogram(found, column, BINS)
        sections.append(long(h, f"histogram_{column}", [c for c in h.columns if c != "bin"], "bin"))
    ends = found.agg(F.min("SNR"), F.max("SNR"), F.min("trail_length"), F.max("trail_length")).first()
    for section, flag in (("completeness", F.col("nn_detected")), ("completeness_nn_only", F.col("nn_detected") & ~O.stack_flag(objects.columns))):
        grid = H.completeness_2d(found, "SNR", "trail_length", GRID, GRID, (ends[0], ends[1]), (ends[2], ends[3]), flag)
        sections.append(long(grid, section, ["total", "detected", "ratio"], "bin_x", "bin_y"))
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out
