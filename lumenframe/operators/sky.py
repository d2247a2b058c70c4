"""Joins on the sky and over source footprints.

Joins of exploded rows carry a hint: the planner sizes them as before the explosion, and would broadcast them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import objects as O


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle on the sphere in degrees, by the haversine form."""
    a, b, c, d = map(F.radians, (ra1, dec1, ra2, dec2))
    h = F.sin((d - b) / 2) ** 2 + F.cos(b) * F.cos(d) * F.sin((c - a) / 2) ** 2
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def unmatched(post: DataFrame, pre: DataFrame, radius_arcsec: float = 0.40) -> DataFrame:
    """The rows of post without a row of pre within the radius.

    Declination zones of one radius and right-ascension cells widened by the zone's cosine make it an
    equi-join; each row of pre goes to the cells that its circle can touch.
    """
    size = radius_arcsec / 3600
    zone = lambda dec: F.floor(dec / size).cast("long")
    # A zone's cell width holds the radius at the zone's edge farther from the equator.
    edge = lambda z: F.least(F.lit(89.999), F.greatest(F.abs(z * size), F.abs((z + 1) * size)))
    cells = lambda z: F.greatest(F.lit(1), F.floor(360.0 / (size / F.cos(F.radians(edge(z))) * 1.01)).cast("long"))
    cell = lambda ra, z: F.pmod(F.floor(ra / 360.0 * cells(z)).cast("long"), cells(z))
    right = pre.select(F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), F.explode(F.sequence(zone(F.col("dec")) - 1, zone(F.col("dec")) + 1)).alias("_z"))
    near = F.array(*[F.pmod(F.floor(F.col("_ra") / 360.0 * cells(F.col("_z"))).cast("long") + k, cells(F.col("_z"))) for k in (-1, 0, 1)])
    right = right.withColumn("_c", F.explode(F.array_distinct(near)))
    left = post.withColumn("_lz", zone(F.col("dec"))).withColumn("_lc", cell(F.col("ra"), F.col("_lz")))
    on = (F.col("_lz") == F.col("_z")) & (F.col("_lc") == F.col("_c")) & (separation(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec")) <= size)
    return left.join(right.hint("merge"), on, "left_anti").drop("_lz", "_lc")


def containing(points: DataFrame, images: DataFrame) -> DataFrame:
    """Each point with the first detector of its visit whose frame holds it.

    images: visit, detector, ra0, dec0, scale (degrees a pixel), w, h.
    """
    x = (F.col("ra") - F.col("ra0")) * F.cos(F.radians("dec0")) / F.col("scale")
    y = (F.col("dec") - F.col("dec0")) / F.col("scale")
    hit = points.join(images, "visit").withColumn("x", x).withColumn("y", y).filter((F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h")))
    first = Window.partitionBy("point_id").orderBy("detector")
    return hit.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("point_id", "visit", "detector", "x", "y")


def tangent_pixel(ra: Column, dec: Column, ra0: float, dec0: float, scale_arcsec: float) -> tuple[Column, Column]:
    """Pixel offsets by the gnomonic projection about (ra0, dec0)."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), math.radians(dec0)
    cosc = math.sin(d0) * F.sin(d) + math.cos(d0) * F.cos(d) * F.cos(a)
    unit = math.degrees(1) * 3600 / scale_arcsec
    return unit * F.cos(d) * F.sin(a) / cosc, unit * (math.cos(d0) * F.sin(d) - math.sin(d0) * F.cos(d) * F.cos(a)) / cosc


def tangent_sky(x: Column, y: Column, ra0: float, dec0: float, scale_arcsec: float) -> tuple[Column, Column]:
    """Right ascension and declination of pixel offsets: the inverse of tangent_pixel."""
    xi, eta, d0 = F.radians(x * scale_arcsec / 3600), F.radians(y * scale_arcsec / 3600), math.radians(dec0)
    ra = ra0 + F.degrees(F.atan2(xi, math.cos(d0) - eta * math.sin(d0)))
    return ra, F.degrees(F.asin((math.sin(d0) + eta * math.cos(d0)) / F.sqrt(1 + xi * xi + eta * eta)))


def footprint_pixels(sources: DataFrame) -> DataFrame:
    """image_id, r, c, src_pos of the pixels of spans (y, x0, x1), x1 included."""
    s = sources.select("image_id", "src_pos", F.explode("spans").alias("s"))
    return s.select("image_id", "src_pos", F.col("s.y").alias("r"), F.explode(F.sequence("s.x0", "s.x1")).alias("c"))


def label_raster(sources: DataFrame) -> DataFrame:
    """image_id, r, c, label: the later source wins; labels count from 1 in source order."""
    return footprint_pixels(sources).groupBy("image_id", "r", "c").agg((F.max("src_pos") + 1).alias("label"))


def footprint_hits(objects: DataFrame, truth_px: DataFrame, sources: DataFrame, fraction: float = 0.0, least: int = 1) -> DataFrame:
    """Each object with the first source, in catalog order, that covers enough of its pixels.

    Enough is max(least, int(fraction * the object's pixels)).
    """
    area = truth_px.groupBy("row_pos").agg(F.count("*").alias("_n"))
    shared = truth_px.join(footprint_pixels(sources).hint("merge"), ["image_id", "r", "c"]).groupBy("row_pos", "src_pos").agg(F.count("*").alias("overlap"))
    return _first_of(objects, area, shared, fraction, least)


def _first_of(objects: DataFrame, area: DataFrame, shared: DataFrame, fraction: float, least: int) -> DataFrame:
    need = F.greatest(F.lit(least), F.floor(F.col("_n") * fraction))
    first = shared.join(area.hint("merge"), "row_pos").filter(F.col("overlap") >= need).groupBy("row_pos").agg(F.min_by(F.struct("src_pos", "overlap"), "src_pos").alias("s"))
    return objects.join(first.hint("merge"), "row_pos", "left").select("row_pos", F.col("s").isNotNull().alias("stack_detection"), "s.src_pos", "s.overlap")


def possible_firsts(sources: DataFrame) -> DataFrame:
    """image_id, src_pos, y, x0, x1: the spans of the sources that can be the first to cover enough of an object.

    Of sources with the same spans only the first can be, as all cover as much.  For the same reason a source of one span
    can't be after one that starts at the same pixel and is as long or longer.
    """
    s = sources.filter("src_pos is not null").select("image_id", "src_pos", F.explode("spans").alias("s"))
    s = s.select("src_pos", F.struct("image_id", "s.y", "s.x0", "s.x1").alias("s")).filter("s.x0 <= s.x1")
    shapes = s.groupBy("src_pos").agg(F.sort_array(F.collect_list("s")).alias("shape")).groupBy("shape").agg(F.min("src_pos").alias("src_pos"))
    head, single = F.col("shape")[0], F.size("shape") == 1
    earlier = Window.partitionBy(head["image_id"], head["y"], head["x0"]).orderBy("src_pos").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max(F.when(single, head["x1"])).over(earlier)
    kept = shapes.withColumn("_longest", longest).filter(~single | F.col("_longest").isNull() | (head["x1"] > F.col("_longest")))
    return kept.select("src_pos", F.explode("shape").alias("s")).select("s.image_id", "src_pos", "s.y", "s.x0", "s.x1")


def trail_hits(objects: DataFrame, width: float, h: int, w: int, sources: DataFrame, fraction: float = 0.0, least: int = 1) -> DataFrame:
    """footprint_hits() for objects that are trails of this width in h x w images.

    Pixels are made and counted where an object's row is, and never shuffled; objects are dealt to several tasks for each
    core before, as a small table that is read by one task has many pixels.
    """
    tasks = 4 * objects.sparkSession.sparkContext.defaultParallelism
    near = O.in_reach(objects, width, h, w)
    area = O.pixels_of(near.repartition(tasks, "row_pos"), width).groupBy("row_pos").agg(F.count("*").alias("_n"))
    return _first_of(objects, area, O.covered_spans(near, possible_firsts(sources), width), fraction, least)


def forbidden(mask_px: DataFrame, planes: list[int], labels: DataFrame) -> DataFrame:
    """image_id, r, c where one of the bit planes is set or a source lies."""
    bits = 0
    for p in planes:
        bits |= 1 << p
    bad = mask_px.filter(F.col("mask").bitwiseAND(F.lit(bits)) != 0).select("image_id", "r", "c")
    return bad.unionByName(labels.select("image_id", "r", "c")).distinct()


def placeable(candidates_px: DataFrame, blocked: DataFrame) -> DataFrame:
    """image_id, slot and the first try none of whose pixels is blocked; tries are independent draws."""
    bad = candidates_px.join(blocked.hint("merge"), ["image_id", "r", "c"], "left_semi").select("image_id", "slot", "try").distinct()
    good = candidates_px.select("image_id", "slot", "try").distinct().join(bad.hint("merge"), ["image_id", "slot", "try"], "left_anti")
    return good.groupBy("image_id", "slot").agg(F.min("try").alias("try"))


def simulate(tries_px: DataFrame, blocked: DataFrame, px: DataFrame, flux: Column, level: float, fraction: float, least: int) -> DataFrame:
    """Simulated objects, end to end: each slot's first try off the blocked pixels is placed, its flux is spread over
    its pixels and added to the image, the image is detected at `level`, and each object's pixels are matched.

    tries_px: image_id, slot, row_pos, r, c; px: image_id, r, c, flux.  Returns image_id, slot, row_pos, pixels, found,
    and detected: found is at least max(least, int(fraction * pixels)).
    """
    placed = placeable(tries_px.withColumn("try", F.col("row_pos")), blocked).select(F.col("try").alias("row_pos"))
    truth = tries_px.join(placed.hint("merge"), "row_pos", "left_semi")
    size = truth.groupBy("row_pos").agg(F.count("*").alias("pixels"))
    injected = truth.join(size.hint("merge"), "row_pos").select("image_id", "r", "c", (flux / F.col("pixels")).alias("flux"))
    image = px.select("image_id", "r", "c", "flux").unionByName(injected).groupBy("image_id", "r", "c").agg(F.sum("flux").alias("flux"))
    hit = image.filter(F.col("flux") >= level).select("image_id", "r", "c", F.lit(1).alias("_hit"))
    found = truth.join(hit.hint("merge"), ["image_id", "r", "c"], "left").groupBy("image_id", "slot", "row_pos").agg(F.count("*").alias("pixels"), F.count("_hit").alias("found"))
    return found.withColumn("detected", F.col("found") >= F.greatest(F.lit(least), F.floor(F.col("pixels") * fraction)))
