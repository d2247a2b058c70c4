"""Objects against components: overlap joins, greedy matching, and detector comparison.

An object is a centred segment of `trail_length` at (x, y), `beta` degrees from +x; it covers the
pixels whose centres are within width / 2 of the segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.components import label_components, neighbours, reach_of, settled
from lumenframe.operators.pixels import count_if, dilate, scores
from lumenframe.operators.pixels import confusion as pixel_confusion
from lumenframe.operators.pixels import sweep as pixel_sweep
from lumenframe.operators.raster import disk_mask, line_mask

#: Edge of the grid cells that turn the overlap join into an equi-join.
CELL = 32


def covers(width: float, cos: Column | None = None, sin: Column | None = None) -> Column:
    """Whether pixel (r, c) is under the object; cos and sin are those of beta, where they are known."""
    a = F.radians("beta")
    cos, sin = F.cos(a) if cos is None else cos, F.sin(a) if sin is None else sin
    dx, dy, half = F.col("c") - F.col("x"), F.col("r") - F.col("y"), F.col("trail_length") / 2
    t = F.greatest(-half, F.least(half, dx * cos + dy * sin))
    return (dx - t * cos) ** 2 + (dy - t * sin) ** 2 <= (width / 2) ** 2 + 1e-9


def roi(h: int, w: int, psf_width: float) -> list[Column]:
    """x0, x1, y0, y1: half-open bounds around a trail, padded, clipped to the image."""
    a, pad = F.radians("beta"), int(psf_width / 2) + 4
    dx, dy = F.abs(F.cos(a)) * F.col("trail_length") + pad, F.abs(F.sin(a)) * F.col("trail_length") + pad
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n), v)).cast("int")
    return [clip(F.floor(F.round(F.col("x") - dx, 9)), w).alias("x0"), clip(F.ceil(F.round(F.col("x") + dx, 9)) + 1, w).alias("x1"), clip(F.floor(F.round(F.col("y") - dy, 9)), h).alias("y0"), clip(F.ceil(F.round(F.col("y") + dy, 9)) + 1, h).alias("y1")]


def in_cells(objects: DataFrame, width: float, columns: list[str]) -> DataFrame:
    """A row for each object and grid cell that its square can reach."""
    half = F.col("trail_length") / 2 + width / 2 + 1
    cells = lambda v: F.sequence(F.floor((v - half) / CELL).cast("int"), F.floor((v + half) / CELL).cast("int"))
    rows = objects.select(*columns, F.explode(cells(F.col("y"))).alias("cr"))
    return rows.withColumn("cc", F.explode(cells(F.col("x"))))


def of_objects(px: DataFrame, objects: DataFrame) -> DataFrame:
    """The rows of px in images that have objects."""
    return px.join(objects.select("image_id").distinct(), "image_id", "left_semi")


def overlaps(objects: DataFrame, px: DataFrame, width: float, how: str = "inner") -> DataFrame:
    """row_pos and the columns of px for every pixel under an object; joined by image and grid cell.

    With "left" other pixels of images that have objects are there too, without row_pos.
    The planner takes exploded rows for as many as there are objects, so without the hint it would broadcast them.
    """
    a = F.radians("beta")
    turned = objects.select("image_id", "row_pos", "x", "y", "trail_length", F.cos(a).alias("_cos"), F.sin(a).alias("_sin"))
    cut = in_cells(turned, width, turned.columns)
    at = of_objects(px, objects).withColumn("cr", F.floor(F.col("r") / CELL).cast("int")).withColumn("cc", F.floor(F.col("c") / CELL).cast("int"))
    cut = cut.withColumnsRenamed({k: f"_{k}" for k in ("image_id", "cr", "cc")})
    same = [F.col(k) == F.col(f"_{k}") for k in ("image_id", "cr", "cc")]
    return at.join(cut.hint("merge"), [*same, covers(width, F.col("_cos"), F.col("_sin"))], how).select("row_pos", *px.columns)


def in_reach(objects: DataFrame, width: float, h: int, w: int) -> DataFrame:
    """Objects that reach into h x w images, with the rows _r0 to _r1 and columns _c0 to _c1 in reach and beta's _cos and _sin."""
    a = F.radians("beta")
    reach = lambda f: F.abs(f(a)) * F.col("trail_length") / 2 + width / 2 + 1e-6
    low = lambda v, d: F.greatest(F.lit(0), F.ceil(v - d)).cast("int")
    high = lambda v, d, n: F.least(F.lit(n - 1), F.floor(v + d)).cast("int")
    inside = lambda v, d, n: (F.ceil(v - d) <= n - 1) & (F.floor(v + d) >= 0) & (F.ceil(v - d) <= F.floor(v + d))
    y, x, dy, dx = F.col("y"), F.col("x"), reach(F.sin), reach(F.cos)
    near = objects.filter(inside(y, dy, h) & inside(x, dx, w))
    return near.select("image_id", "row_pos", "x", "y", "trail_length", F.cos(a).alias("_cos"), F.sin(a).alias("_sin"), low(y, dy).alias("_r0"), high(y, dy, h).alias("_r1"), low(x, dx).alias("_c0"), high(x, dx, w).alias("_c1"))


def pixels_of(near: DataFrame, width: float) -> DataFrame:
    """image_id, row_pos, r, c of all pixels under objects of in_reach."""
    cells = near.withColumn("r", F.explode(F.sequence("_r0", "_r1"))).withColumn("c", F.explode(F.sequence("_c0", "_c1")))
    return cells.filter(covers(width, F.col("_cos"), F.col("_sin"))).select("image_id", "row_pos", "r", "c")


def trail_pixels(objects: DataFrame, width: float, h: int, w: int) -> DataFrame:
    """image_id, row_pos, r, c of all pixels of h x w images that lie under each object."""
    return pixels_of(in_reach(objects, width, h, w), width)


def covered_spans(near: DataFrame, spans: DataFrame, width: float) -> DataFrame:
    """row_pos, src_pos, overlap: how many pixels of a source's spans (image_id, src_pos, y, x0, x1) are under an object of in_reach.

    Joined by image and grid cell; a span is cut at the cells' edges, and only the pixels that both can have are tested.
    """
    cell = lambda v: F.floor(F.col(v) / CELL).cast("int")
    cells = near.withColumn("cr", F.explode(F.sequence(cell("_r0"), cell("_r1")))).withColumn("cc", F.explode(F.sequence(cell("_c0"), cell("_c1"))))
    parts = spans.select(F.col("image_id").alias("_image"), "src_pos", F.col("y").alias("r"), cell("y").alias("_cr"), "x0", "x1", F.explode(F.sequence(cell("x0"), cell("x1"))).alias("_cc"))
    parts = parts.withColumn("x0", F.greatest("x0", F.col("_cc") * CELL)).withColumn("x1", F.least("x1", F.col("_cc") * CELL + CELL - 1))
    same = (F.col("image_id") == F.col("_image")) & (F.col("cr") == F.col("_cr")) & (F.col("cc") == F.col("_cc"))
    meet = F.col("r").between(F.col("_r0"), F.col("_r1")) & (F.col("x0") <= F.col("_c1")) & (F.col("x1") >= F.col("_c0"))
    both = cells.join(parts.hint("merge"), same & meet).withColumn("c", F.explode(F.sequence(F.greatest("x0", "_c0"), F.least("x1", "_c1"))))
    return both.filter(covers(width, F.col("_cos"), F.col("_sin"))).groupBy("row_pos", "src_pos").agg(F.count("*").alias("overlap"))


def edges(objects: DataFrame, labelled: DataFrame, width: float) -> DataFrame:
    """image_id, row_pos, label: components under each object."""
    return overlaps(objects, labelled.select("image_id", "r", "c", "label"), width).select("image_id", "row_pos", "label").distinct()


def consume(links: DataFrame) -> DataFrame:
    """image_id, row_pos, n_free: in catalog order each object takes all free components under it.

    As it takes them all, a component goes to the first object that covers it, so no scan in order is needed.
    """
    first = F.min("row_pos").over(Window.partitionBy("image_id", "label"))
    return links.withColumn("_free", (F.col("row_pos") == first).cast("int")).groupBy("image_id", "row_pos").agg(F.sum("_free").cast("int").alias("n_free"))


def match(objects: DataFrame, links: DataFrame) -> DataFrame:
    """The catalog with nn_detected (any component under it) and tp (at least one free component)."""
    got = consume(links).select("row_pos", "n_free")
    return objects.drop("nn_detected", "tp").join(got.hint("merge"), "row_pos", "left").withColumn("nn_detected", F.col("n_free").isNotNull()).withColumn("tp", F.coalesce(F.col("n_free") > 0, F.lit(False))).drop("n_free")


def ignored(labelled: DataFrame, stack_px: DataFrame) -> DataFrame:
    """image_id, label of components that touch the baseline detector's mask."""
    return labelled.join(stack_px.select("image_id", "r", "c").distinct().hint("merge"), ["image_id", "r", "c"], "left_semi").select("image_id", "label").distinct()


def confusion(objects: DataFrame, labelled: DataFrame, width: float, stack_px: DataFrame | None = None, per_threshold: bool = False) -> DataFrame:
    """tp, fp, fn over images that have objects.

    Without a mask fp is the components less the true positives, of each image, at least 0.  With one it
    is the components that are neither taken nor touch the mask; per_threshold takes the sweep's rule
    instead: components less true positives less untaken components on the mask, at least 0.
    """
    return _confusion(objects, labelled, _over(objects, labelled, width), stack_px, per_threshold)


def _over(objects: DataFrame, labelled: DataFrame, width: float) -> DataFrame:
    return overlaps(objects, labelled.select("image_id", "r", "c", "label"), width)


def _confusion(objects: DataFrame, labelled: DataFrame, over: DataFrame, stack_px: DataFrame | None, per_threshold: bool = False) -> DataFrame:
    """A component goes to the first object over it, which is an aggregate of components alone: links are not listed.

    What is joined grows with pixels, components or objects, so no side of it goes to the driver.
    """
    own = over.groupBy("image_id", "label").agg(F.min("row_pos").alias("owner"))
    owners = own.select(F.col("owner").alias("row_pos")).distinct().withColumn("tp", F.lit(True))
    matched = objects.select("image_id", "row_pos").join(owners.hint("merge"), "row_pos", "left").withColumn("tp", F.col("tp").isNotNull())
    hits = matched.groupBy("image_id").agg(count_if(F.col("tp")).alias("tp"), count_if(~F.col("tp")).alias("fn"))
    if stack_px is None:
        parts = labelled.select("image_id", "label").distinct().withColumn("mask", F.lit(None).cast("boolean"))
    else:
        mask = of_objects(stack_px, objects).select("image_id", "r", "c").distinct().withColumn("mask", F.lit(True))
        marked = labelled.select("image_id", "r", "c", "label").join(mask.hint("merge"), ["image_id", "r", "c"], "left")
        parts = marked.groupBy("image_id", "label").agg(F.max("mask").alias("mask"))
    parts = parts.join(own.hint("merge"), ["image_id", "label"], "left")
    free = F.col("owner").isNull()
    n = parts.groupBy("image_id").agg(F.count("*").alias("n"), count_if(free & F.col("mask").isNotNull()).alias("skipped"), count_if(free & F.col("mask").isNull()).alias("open"))
    both = hits.join(n, "image_id", "left").na.fill(0, ["n", "skipped", "open"])
    fp = F.col("open") if stack_px is not None and not per_threshold else F.greatest(F.col("n") - F.col("tp") - F.col("skipped"), F.lit(0))
    return both.agg(F.sum("tp").alias("obj_tp"), F.sum(fp).alias("obj_fp"), F.sum("fn").alias("obj_fn"))


def full_confusion(objects: DataFrame, px: DataFrame, labelled: DataFrame, width: float, threshold: float, stack_px: DataFrame | None = None) -> DataFrame:
    """Object and pixel confusion at one threshold, in one row; px has gt."""
    pix = pixel_confusion(px, threshold)
    return confusion(objects, labelled, width, stack_px).join(pix.select(*[F.col(c).alias(f"pix_{c}") for c in pix.columns]))


def covered_confusion(objects: DataFrame, px: DataFrame, width: float, gap: int, threshold: float) -> DataFrame:
    """full_confusion where truth is to lie under an object; px holds each pixel once, and its components are labelled here.

    One join finds the first object over each pixel, which is both its truth and, at its least, the owner of its
    component.  Truth lies in images with objects alone, so of all other pixels only hits and misses are counted.
    """
    over = overlaps(objects, px.select("image_id", "r", "c", "p"), width, "left")
    owned = over.groupBy("image_id", "r", "c").agg(F.max("p").alias("p"), F.min("row_pos").alias("row_pos"))
    hit, true = F.col("p") >= threshold, F.col("row_pos").isNotNull()
    labelled = label_components(owned.filter(hit), gap)
    objs = _confusion(objects, labelled, labelled.filter(true), None)
    pix = px.agg(count_if(hit).alias("hits"), count_if(~hit).alias("misses")).join(owned.agg(count_if(hit & true).alias("pix_tp"), count_if(~hit & true).alias("pix_fn")))
    return objs.join(pix.select("pix_tp", (F.col("hits") - F.col("pix_tp")).alias("pix_fp"), "pix_fn", (F.col("misses") - F.col("pix_fn")).alias("pix_tn")))


def _scan_image(thresholds: list[float], reach: int):
    """Counts of one image at all thresholds: pixels are added from the highest down, so components only merge."""
    down = sorted(range(len(thresholds)), key=lambda i: -thresholds[i])

    def run(px: pa.Table, over: pa.Table) -> pa.Table:
        r, c = (px.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
        p, mask = px.column("p").to_numpy(), px.column("mask").to_numpy(zero_copy_only=False)
        a, b = neighbours(r, c, reach)
        weight = np.minimum(p[a], p[b])
        place = {(y, x): i for i, (y, x) in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
        under = np.array([place[yx] for yx in zip(over.column("r").to_pylist(), over.column("c").to_pylist(), strict=True)], dtype=np.int64)
        rows = over.column("row_pos").to_numpy() if over.num_rows else np.zeros(0, np.int64)
        root, above, out = np.arange(len(p)), np.inf, []
        for i in down:
            t = thresholds[i]
            fresh = (weight >= t) & (weight < above)
            root, above = settled(root, a[fresh], b[fresh]), t
            active = p >= t
            roots = np.unique(root[active])
            on = active[under]
            owner = np.full(len(p), np.iinfo(np.int64).max)
            np.minimum.at(owner, root[under[on]], rows[on])
            taken = owner < np.iinfo(np.int64).max
            skipped = np.unique(root[active & mask])
            out.append((i, len(roots), len(np.unique(owner[taken])), int((~taken[skipped]).sum())))
        kinds = {"thr_idx": pa.int32(), "n": pa.int64(), "tp": pa.int64(), "skipped": pa.int64()}
        image = px.column("image_id") if px.num_rows else over.column("image_id")
        return pa.table([pa.array([image[0].as_py()] * len(out), pa.int64())] + [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=["image_id", *kinds])

    return run


def sweep(objects: DataFrame, px: DataFrame, width: float, gap: int, thresholds: list[float], stack_px: DataFrame | None = None) -> DataFrame:
    """obj_tp, obj_fp, obj_fn and scores at each threshold, over images that have objects.

    Pixels are read and joined with objects once; an image's components at all thresholds are one task's work.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("thr_idx"), F.lit(float(t)).alias("thr")) for i, t in enumerate(thresholds)])
    images = objects.groupBy(F.col("image_id").cast("long").alias("image_id")).agg(F.count("*").alias("n_obj"))
    kept = px.filter(F.col("p") >= min(thresholds)).select(F.col("image_id").cast("long").alias("image_id"), "r", "c", F.col("p").cast("double").alias("p")).join(images, "image_id", "left_semi")
    if stack_px is None:
        kept = kept.withColumn("mask", F.lit(False))
    else:
        mask = of_objects(stack_px, objects).select("image_id", "r", "c", F.lit(True).alias("mask")).distinct()
        kept = kept.join(mask.hint("merge"), ["image_id", "r", "c"], "left").na.fill(False, ["mask"])
    over = overlaps(objects, kept.select("image_id", "r", "c"), width).select(*[F.col(c).alias(c) for c in ("image_id", "r", "c")], F.col("row_pos").cast("long").alias("row_pos"))
    counts = kept.groupBy("image_id").cogroup(over.groupBy("image_id")).applyInArrow(_scan_image([float(t) for t in thresholds], reach_of(gap)), "image_id long, thr_idx int, n long, tp long, skipped long")
    every = images.withColumn("_s", F.explode(steps)).select("image_id", "n_obj", "_s.*")
    both = every.join(counts, ["image_id", "thr_idx"], "left").na.fill(0, ["n", "tp", "skipped"])
    fp = F.greatest(F.col("n") - F.col("tp") - F.col("skipped"), F.lit(0))
    out = both.groupBy("thr_idx", "thr").agg(F.sum("tp").alias("obj_tp"), F.sum(fp).alias("obj_fp"), F.sum(F.col("n_obj") - F.col("tp")).alias("obj_fn"))
    return out.select("*", *scores("obj_tp", "obj_fp", "obj_fn", "obj_"))


def threshold_scan(objects: DataFrame, px: DataFrame, width: float, gap: int, n: int = 51, lo: float = 0.0, hi: float = 1.0, stack_px: DataFrame | None = None) -> DataFrame:
    """Pixel and object counts and scores at n evenly spaced thresholds; px has gt."""
    steps = [round(lo + (hi - lo) * i / max(1, n - 1), 9) for i in range(n)]
    return pixel_sweep(px, n, lo, hi).join(sweep(objects, px, width, gap, steps, stack_px).drop("thr"), "thr_idx")


def any_overlap(objects: DataFrame, px: DataFrame, gap: int, h: int, w: int, width: int = 1) -> DataFrame:
    """row_pos, nn_detected: whether a line along the object, or a disk where it has no direction or length,
    meets the grown pixels."""
    grown = dilate(px.select("image_id", "r", "c"), gap) if gap > 1 else px.select("image_id", "r", "c")
    known = F.coalesce(~F.isnan("beta") & ~F.isnan("trail_length") & (F.abs("beta") < float("inf")) & (F.abs("trail_length") < float("inf")), F.lit(False))
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(v).cast("int"))).alias(v)
    placed = objects.select("image_id", "row_pos", clip("x", w), clip("y", h), "beta", "trail_length")
    probes = line_mask(placed.filter(known), h, w, width).unionByName(disk_mask(placed.filter(~known), h, w, max(1, gap)))
    hit = probes.join(grown.hint("merge"), ["image_id", "r", "c"], "left_semi").select("row_pos").distinct().withColumn("_hit", F.lit(True))
    return objects.select("row_pos").join(hit.hint("merge"), "row_pos", "left").select("row_pos", F.coalesce("_hit", F.lit(False)).alias("nn_detected"))


def stack_flag(columns: list[str]) -> Column:
    """The baseline detector's flag by which columns there are: stack_detected, stack_detection, or a magnitude."""
    for name in ("stack_detected", "stack_detection"):
        if name in columns:
            return F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    if "stack_mag" in columns:
        return F.col("stack_mag").isNotNull() & ~F.isnan("stack_mag")
    return F.lit(False)


def stack_metrics(objects: DataFrame, labels: DataFrame) -> DataFrame:
    """tp, fn by the flag; fp is the sum of each image's largest label; tn is unknown."""
    hit = stack_flag(objects.columns)
    fp = labels.groupBy("image_id").agg(F.max("label").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("fp"))
    return objects.agg(count_if(hit).alias("tp"), count_if(~hit).alias("fn")).join(fp).select("tp", "fp", "fn", F.lit(None).cast("long").alias("tn"))


def combined(objects: DataFrame, labelled: DataFrame, width: float, stack_px: DataFrame) -> DataFrame:
    """tp: found by either detector; fn: by neither; fp: components that are free and off the mask, and the mask's own false ones.

    The mask's pixels stand for the baseline detector's false positives: each of its components is one.
    """
    over = _over(objects, labelled, width)
    own = _confusion(objects, labelled, over, stack_px).select("obj_fp")
    seen = over.select("row_pos").distinct().withColumn("_seen", F.lit(True))
    either = F.col("_seen").isNotNull() | stack_flag(objects.columns)
    both = objects.join(seen.hint("merge"), "row_pos", "left").agg(count_if(either).alias("tp"), count_if(~either).alias("fn"))
    mask = label_components(stack_px.select("image_id", "r", "c").distinct(), 1).groupBy("image_id").agg(F.max("label").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("stack_fp"))
    return both.join(own).join(mask).select("tp", "fn", (F.col("obj_fp") + F.col("stack_fp")).alias("fp"))
