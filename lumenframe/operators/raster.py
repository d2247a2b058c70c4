"""Rasters of trails and disks by sampling, and bilinear resizing.

Each function returns image_id, row_pos, r, c of the pixels of every object inside an h x w image.
Samples are rounded half to even.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _near(v: Column) -> Column:
    return F.rint(F.round(v, 9)).cast("int")


def _samples(objects: DataFrame, n: Column) -> DataFrame:
    return objects.withColumn("_n", n.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))


def _stamp(points: DataFrame, h: int, w: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """Distinct pixels at the offsets from points (_r, _c)."""
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    px = points.select("image_id", "row_pos", "_r", "_c").distinct().withColumn("_o", F.explode(o))
    px = px.select("image_id", "row_pos", (F.col("_r") + F.col("_o.a")).alias("r"), (F.col("_c") + F.col("_o.b")).alias("c"))
    return px.filter(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1)).distinct()


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def square_offsets(half: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1)]


def trail_from_start(objects: DataFrame, h: int, w: int, thickness: int) -> DataFrame:
    """From (x, y) towards `beta` degrees east of north, y pointing down, stamped with disks."""
    p = _samples(objects, F.greatest(F.lit(2), F.floor("trail_length")))
    t, a = F.col("trail_length") * F.col("_i") / (F.col("_n") - 1), F.radians("beta")
    p = p.withColumn("_c", _near(F.col("x") + t * F.sin(a))).withColumn("_r", _near(F.col("y") - t * F.cos(a)))
    return _stamp(p, h, w, disk_offsets(max(1, thickness // 2)))


def line_mask(objects: DataFrame, h: int, w: int, width: int) -> DataFrame:
    """Centred at (x, y), `beta` degrees from +x, by ceil(2 L) samples clipped to the border, dilated by a square."""
    p = _samples(objects, F.greatest(F.lit(2), F.ceil(2 * F.col("trail_length"))))
    t, a = F.col("trail_length") * (F.col("_i") / (F.col("_n") - 1) - 0.5), F.radians("beta")
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    p = p.withColumn("_c", clip(_near(F.col("x") + t * F.cos(a)), w)).withColumn("_r", clip(_near(F.col("y") + t * F.sin(a)), h))
    return _stamp(p, h, w, square_offsets(width // 2))


def disk_mask(objects: DataFrame, h: int, w: int, radius: int) -> DataFrame:
    p = objects.withColumn("_r", F.col("y").cast("int")).withColumn("_c", F.col("x").cast("int"))
    return _stamp(p, h, w, disk_offsets(radius))


def stamps(objects: DataFrame, px: DataFrame, side: int, h: int, w: int, value: str = "p") -> DataFrame:
    """row_pos, r, c, value: side x side pixels about each object's nearest pixel; r and c count from the stamp's corner.

    Pixels of the image that px lacks are 0, pixels outside the h x w image null.
    """
    half = side // 2
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(side) for b in range(side)])
    at = objects.select("image_id", "row_pos", F.explode(cells).alias("o"), _near(F.col("y")).alias("_y"), _near(F.col("x")).alias("_x"))
    at = at.select("image_id", "row_pos", F.col("o.a").alias("_a"), F.col("o.b").alias("_b"), (F.col("_y") - half + F.col("o.a")).alias("r"), (F.col("_x") - half + F.col("o.b")).alias("c"))
    inside = F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1)
    got = at.join(px.select("image_id", "r", "c", F.col(value).alias("_v")), ["image_id", "r", "c"], "left")
    return got.select("row_pos", F.col("_a").alias("r"), F.col("_b").alias("c"), F.when(inside, F.coalesce("_v", F.lit(0.0))).alias(value))


#: Shares of moved images that are held at once.
TEMPLATE_PARTS = 1 << 20


def _templates(u: np.ndarray, v: np.ndarray, value: np.ndarray, side: int, step: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function of lengths, angles in degrees and the stamp that each object adds to; it gives the stamps' pixels: places stamp * side^2 + r * side + c, sorted, and values of sum 1 by stamp."""
    weight = np.maximum(value, 0.0)
    cu, cv, total = (u * weight).sum() / weight.sum(), (v * weight).sum() / weight.sum(), value.sum()
    # What a pixel of the moved image holds: its own pixel and those before it, by (i, j), where the image has them.
    u0, v0 = min(u.min(), 0), min(v.min(), 0)
    shape = (int(v.max() - v0) + 1, int(u.max() - u0) + 1)
    taps, there = np.zeros((2, 2, *shape)), np.zeros(shape, dtype=bool)
    for i in (0, 1):
        for j in (0, 1):
            ok = (u + i <= u.max()) & (v + j <= v.max())
            at = (v[ok] + j - v0).astype(np.int64), (u[ok] + i - u0).astype(np.int64)
            np.add.at(taps[i, j], at, value[ok] / total)
            there[at] = True
    dv, du = (x.astype(np.int64) for x in np.nonzero(there))
    taps, dv, du = taps[:, :, there], dv + int(v0), du + int(u0)
    centre, reach = (side - 1) / 2, 1.5 * (side + max(np.abs(dv).max(), np.abs(du).max()) + max(abs(cu), abs(cv)) + 2)

    def run(length: np.ndarray, beta: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.maximum(np.ceil(length / step) + 1, 21)
        # Of the n points only those count whose image can meet the stamp.
        far = np.divide(reach, np.abs(length), out=np.full(len(length), np.inf), where=length != 0)
        low = np.maximum(0, np.ceil((0.5 - far) * (n - 1))).astype(np.int64)
        high = np.minimum(n - 1, np.floor((0.5 + far) * (n - 1))).astype(np.int64)
        many = np.maximum(0, high - low + 1)
        of = np.repeat(np.arange(len(length)), many)
        i = low[of] + np.arange(len(of)) - (np.cumsum(many) - many)[of]
        along, angle = (i / (n[of] - 1) - 0.5) * length[of], np.radians(beta)
        tx, ty = centre + along * np.cos(angle)[of] - cu, centre + along * np.sin(angle)[of] - cv
        x0, y0 = np.floor(np.round(tx, 9)), np.floor(np.round(ty, 9))
        fx, fy = (tx - x0)[:, None], (ty - y0)[:, None]
        parts = (1 - fx) * ((1 - fy) * taps[0, 0] + fy * taps[0, 1]) + fx * ((1 - fy) * taps[1, 0] + fy * taps[1, 1])
        r, c = y0.astype(np.int64)[:, None] + dv, x0.astype(np.int64)[:, None] + du
        inside = (r >= 0) & (r < side) & (c >= 0) & (c < side)
        place = (stamp[of][:, None] * (side * side) + r * side + c)[inside]
        size = (int(stamp.max(initial=-1)) + 1) * side * side
        held = np.zeros(size, dtype=bool)
        held[place] = True
        place, image = np.flatnonzero(held), np.bincount(place, parts[inside], size)
        x = np.maximum(image[place], 0.0)
        every = np.bincount(place // (side * side), x, int(stamp.max(initial=-1)) + 1)[place // (side * side)]
        place, x, every = place[every > 0], x[every > 0], every[every > 0]
        return place, x / every, place // (side * side)

    return run


def trail_template(objects: DataFrame, psf: DataFrame, side: int, step: float) -> DataFrame:
    """row_pos, r, c, value: the point-spread image moved along each object's centred segment, of sum 1.

    psf is a small image (u, v, value) of n x m pixels, its centroid is put on max(ceil(L / step) + 1, 21) evenly spaced points;
    parts of a pixel are shared bilinearly within the moved image's own frame, and what leaves the stamp is lost.  Objects of the
    same row_pos add up to one stamp; without a row_pos, a length or an angle, or with an infinite one, there is none.

    A stamp is made whole in one place, so its parts, of which there are thousands, are never rows.
    """
    small = psf.select(F.col("u").cast("double"), F.col("v").cast("double"), F.col("value").cast("double")).collect()  # one point-spread image
    u, v, value = (np.array([p[k] for p in small], dtype=float) for k in range(3))
    make, each = _templates(u, v, value, side, step), max(1, TEMPLATE_PARTS // (21 * max(1, len(small))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, each):
                some = batch.slice(start, each)
                m = some.column("m")
                stamp = np.repeat(np.arange(len(m)), np.diff(m.offsets.to_numpy()))
                flat = m.flatten()
                place, x, of = make(flat.field("trail_length").to_numpy(), flat.field("beta").to_numpy(), stamp)
                at = place - of * (side * side)
                yield pa.RecordBatch.from_arrays([some.column("row_pos").take(pa.array(of)), pa.array((at // side).astype(np.int32)), pa.array((at % side).astype(np.int32)), pa.array(x)], names=["row_pos", "r", "c", "value"])

    known = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    few = objects.select("row_pos", F.col("trail_length").cast("double").alias("trail_length"), F.col("beta").cast("double").alias("beta")).filter(F.col("row_pos").isNotNull() & known("trail_length") & known("beta"))
    kind = dict(objects.dtypes)["row_pos"]
    return few.groupBy("row_pos").agg(F.collect_list(F.struct("trail_length", "beta")).alias("m")).mapInArrow(run, f"row_pos {kind}, r int, c int, value double")


def resize_bilinear(px: DataFrame, h: int, w: int, h2: int, w2: int, value: str = "p") -> DataFrame:
    """image_id, r, c, value with half-pixel centres; the same image when sizes agree."""

    def taps(n: int, m: int) -> Column:
        """Of each output position: sources and their weights."""
        out = []
        for i in range(m):
            at = max(0.0, (i + 0.5) * n / m - 0.5)
            lo = min(int(at), n - 1)
            out += [(i, lo, 1 - (at - lo)), (i, min(lo + 1, n - 1), at - lo)]
        return F.array(*[F.struct(F.lit(i).alias("to"), F.lit(s).alias("at"), F.lit(float(k)).alias("k")) for i, s, k in out])

    rows = px.withColumn("_t", F.explode(F.filter(taps(h, h2), lambda t: t["at"] == F.col("r"))))
    both = rows.withColumn("_u", F.explode(F.filter(taps(w, w2), lambda t: t["at"] == F.col("c"))))
    return both.groupBy("image_id", F.col("_t.to").alias("r"), F.col("_u.to").alias("c")).agg(F.sum(F.col(value) * F.col("_t.k") * F.col("_u.k")).alias(value))
