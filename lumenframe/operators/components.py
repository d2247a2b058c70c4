"""Connected components of pixels with gap bridging, their measurement and filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reach_of(gap: int) -> int:
    """The Chebyshev distance at which pixels join: dilation by a square of radius gap bridges 2 * gap."""
    return 2 * gap + 1 if gap > 1 else 1


def neighbours(r: np.ndarray, c: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of pixels within Chebyshev distance reach; repeated pixels are chained."""
    if len(r) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stride = int(c.max() - c.min()) + 2 * reach + 2
    key = (r.astype(np.int64) - r.min()) * stride + (c.astype(np.int64) - c.min())
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    pairs = [(same, same + 1)]
    for dr in range(reach + 1):
        for dc in range(-reach if dr else 1, reach + 1):
            want = ranked + dr * stride + dc
            at = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
            hit = np.flatnonzero(ranked[at] == want)
            pairs.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return order[a], order[b]


def settled(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots, smallest places, after the places a and b are joined too."""
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    return root


def component_roots(r: np.ndarray, c: np.ndarray, reach: int) -> np.ndarray:
    """For each pixel the smallest place in its component."""
    return settled(np.arange(len(r)), *neighbours(r, c, reach))


def label_components(px: DataFrame, gap: int = 3) -> DataFrame:
    """px (image_id, r, c and any others) with `label`, 1, 2, ... in raster order of the grown components.

    An image is one task's work; the images spread over the cluster.  Repeated pixels get one label.
    """
    reach, grow = reach_of(gap), gap if gap > 1 else 0

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
        root = component_roots(r, c, reach)
        first = np.maximum(0, r - grow) * (1 << 32) + np.maximum(0, c - grow)
        roots, where = np.unique(root, return_inverse=True)
        least = np.full(len(roots), np.iinfo(np.int64).max)
        np.minimum.at(least, where, first)
        rank = np.empty(len(roots), dtype=np.int32)
        rank[np.argsort(least, kind="stable")] = np.arange(1, len(roots) + 1)
        return table.append_column("label", pa.array(rank[where], pa.int32()))

    fields = ", ".join(f"`{n}` {t}" for n, t in px.dtypes)
    return px.groupBy("image_id").applyInArrow(run, f"{fields}, label int")


def top_mean(values: Column, fraction: float, up: bool = True) -> Column:
    """Mean of the largest share of an array: at least one value, rounded up or down."""
    share = F.size(values) * F.lit(fraction)
    k = F.greatest(F.lit(1), (F.ceil(share) if up else F.floor(share)).cast("int"))
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), k)
    return F.aggregate(top, F.lit(0.0), lambda a, b: a + b) / F.size(top)


def measure(labelled: DataFrame, score: str = "topk_mean", fraction: float = 0.05) -> DataFrame:
    """A row for each component: area, centroid, scores and half-open bounds, over its own pixels."""
    out = labelled.groupBy("image_id", "label").agg(
        F.count("*").cast("int").alias("area"), F.avg("c").alias("x"), F.avg("r").alias("y"), F.max("p").alias("peak_probability"), F.avg("p").alias("mean_probability"), F.sum("p").alias("_sum"),
        F.min("c").alias("bbox_x0"), (F.max("c") + 1).alias("bbox_x1"), F.min("r").alias("bbox_y0"), (F.max("r") + 1).alias("bbox_y1"), F.collect_list("p").alias("_p"),
    ).withColumn("topk_mean_probability", top_mean(F.col("_p"), fraction))
    chosen = {"max": "peak_probability", "mean": "mean_probability", "sum": "_sum", "topk_mean": "topk_mean_probability"}[score]
    return out.withColumn("score", F.col(chosen)).drop("_sum", "_p")


def accept(measured: DataFrame, min_area: int = 1, max_area: int | None = None, min_score: float = 0.0, min_peak: float = 0.0) -> DataFrame:
    """Components within the limits, numbered anew in order of their labels."""
    ok = (F.col("area") >= min_area) & (F.col("score") >= min_score) & (F.col("peak_probability") >= min_peak)
    if max_area is not None:
        ok &= F.col("area") <= max_area
    return measured.filter(ok).withColumn("label_id", F.row_number().over(Window.partitionBy("image_id").orderBy("label")))


def paint(px: DataFrame, low: float = 0.1, gap: int = 10, method: str = "max", fraction: float = 0.05) -> DataFrame:
    """px with p replaced by the component's score on every pixel of the grown component."""
    labelled = label_components(px.filter(F.col("p") >= low).select("image_id", "r", "c", "p"), gap)
    value = F.max("p") if method == "max" else top_mean(F.collect_list("p"), fraction, up=False)
    score = labelled.groupBy("image_id", "label").agg(value.alias("_score"))
    g = gap if gap > 1 else 0
    # Only cells that hold pixels matter: pixels meet those of the cells of edge 2 g + 1 that they can reach.
    edge = 2 * g + 1
    cell = lambda v: F.floor(v / edge).cast("int")
    reached = lambda v: F.array_distinct(F.array(cell(F.col(v) - g), cell(F.col(v) + g)))
    spread = labelled.select("image_id", "label", F.col("r").alias("_r"), F.col("c").alias("_c"), F.explode(reached("r")).alias("_cr"), "c").withColumn("_cc", F.explode(reached("c"))).drop("c")
    at = px.select("image_id", "r", "c", cell(F.col("r")).alias("_cr"), cell(F.col("c")).alias("_cc")).distinct()
    near = at.join(spread.hint("merge"), ["image_id", "_cr", "_cc"])
    near = near.filter((F.abs(F.col("r") - F.col("_r")) <= g) & (F.abs(F.col("c") - F.col("_c")) <= g))
    painted = near.groupBy("image_id", "r", "c").agg(F.min("label").alias("label")).join(score, ["image_id", "label"])
    return px.join(painted.select("image_id", "r", "c", "_score"), ["image_id", "r", "c"], "left").withColumn("p", F.coalesce("_score", "p")).drop("_score")
