"""Scalar expressions: angles, rates, magnitudes, templates, schedules and seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the photometric model.
FWHM_PER_SIGMA = 2.354820045
ZERO_POINT = 31.4  # AB magnitude of one nanojansky
TRAILING_A, TRAILING_B = 0.42, 0.0
TWO_PI = 2 * math.pi
UINT32 = 4294967295


def ensure_radians(a: Column) -> Column:
    """Degrees if the size exceeds a full turn, else radians already."""
    return F.when(F.abs(a) > TWO_PI, F.radians(a)).otherwise(a)


def wrap_radians(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def wrap_degrees(a: Column) -> Column:
    return F.degrees(wrap_radians(F.radians(a)))


def sky_speed(ra_rate: Column, dec_rate: Column) -> Column:
    return F.hypot(ra_rate, dec_rate)


def position_angle(ra_rate: Column, dec_rate: Column) -> Column:
    """Degrees east of north, from 0 to 360."""
    return F.pmod(F.degrees(F.atan2(ra_rate, dec_rate)) + 360, F.lit(360.0))


def trail_pixels(deg_per_day: Column, exposure_s: float, scale_arcsec: float) -> Column:
    return deg_per_day * 3600 / 86400 * exposure_s / scale_arcsec


def snr_of(mag: Column, limit: Column) -> Column:
    """Detection scale: 5 at the limiting magnitude."""
    return 5 * F.pow(F.lit(10.0), 0.4 * (limit - mag))


def mag_of(snr: Column, limit: Column) -> Column:
    """The inverse of snr_of; null where the ratio isn't positive."""
    return F.when(snr > 0, limit - 2.5 * F.log10(snr / 5))


def snr_measured(mag: Column, zero: float, sigma_f: Column, correction: Column) -> Column:
    """Measurement scale: flux over the flux sigma of a trail, times the correction for its length; null on a bad sigma."""
    good = F.when((sigma_f > 0) & (sigma_f < float("inf")), sigma_f)
    return F.pow(F.lit(10.0), 0.4 * (zero - mag)) / good * correction


def mag_measured(snr: Column, zero: float, sigma_f: Column, correction: Column) -> Column:
    """The inverse of snr_measured; null on a bad sigma, correction or ratio."""
    flux = F.when((sigma_f > 0) & (sigma_f < float("inf")) & (correction > 0), snr * sigma_f / correction)
    return F.when(flux > 0, zero - 2.5 * F.log10(flux))


def injection(mode: str, drawn: Column, length: Column, psf: Column, limit: Column) -> dict[str, Column]:
    """Magnitudes of an injected object from what was drawn: snr, psf_mag, surface_brightness or integrated_mag.

    A point source, of length 0 or less, has one magnitude.
    """
    trail = length > 0
    loss, per_length = F.when(trail, trailing_loss(length, psf)).otherwise(0.0), F.when(trail, 2.5 * F.log10(length)).otherwise(0.0)
    if mode == "snr":
        magnitude = mag_of(F.greatest(drawn, F.lit(0.01)), limit) - loss
    elif mode == "psf_mag":
        magnitude = drawn - loss
    elif mode == "surface_brightness":
        magnitude = drawn - per_length
    elif mode == "integrated_mag":
        magnitude = drawn
    else:
        raise ValueError(f"unknown mode of magnitudes: {mode}")
    point = magnitude + loss
    return {"source_type": source_type(length), "mag": magnitude + per_length, "integrated_mag": magnitude, "PSF_mag": point, "SNR": snr_of(point, limit)}


def snr_correction(length: Column, a: float, b: float, l0: float, p: float) -> Column:
    """a + b x / (1 + x) with x = (max(length, 0) / l0) ** p."""
    x = F.pow(F.greatest(length, F.lit(0.0)) / l0, F.lit(p))
    return a + b * x / (1 + x)


def midpoint(x0: Column, y0: Column, length: Column, theta: Column) -> tuple[Column, Column]:
    return x0 + length / 2 * F.cos(theta), y0 + length / 2 * F.sin(theta)


def fwhm_arcsec(sigma_px: Column, scale_arcsec: float) -> Column:
    return FWHM_PER_SIGMA * sigma_px * scale_arcsec


def trailing_loss(length: Column, psf: Column, a: float = TRAILING_A, b: float = TRAILING_B) -> Column:
    x = length / psf
    return 1.25 * F.log10(1 + a * x * x / (1 + b * x))


def surface_brightness(mag: Column, length: Column) -> Column:
    """The magnitude of a unit of length; a point source keeps its magnitude."""
    return F.when(length > 0, mag + 2.5 * F.log10(length)).otherwise(mag)


def source_type(length: Column) -> Column:
    return F.when(length > 0, "Trail").otherwise("Star")


def lookup(key: Column, values: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def ramp(epoch: Column, kind: str, e0: float, e1: float, k: float = 0.5) -> Column:
    """From 0 to 1 between two epochs, linear or logistic; a step if they don't differ."""
    if e1 <= e0:
        return F.when(epoch >= e1, 1.0).otherwise(0.0)
    if kind == "linear":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (epoch - e0) / (e1 - e0)))
    return 1 / (1 + F.exp(-k * (epoch - (e0 + e1) / 2)))


def stage_rate(epoch: Column, rates: tuple[float, float, float]) -> Column:
    return F.when(epoch <= 12, rates[0]).when(epoch <= 25, rates[1]).otherwise(rates[2])


def task_seed(seed: int, visit: Column, detector: Column) -> Column:
    """A 32-bit seed of an exposure."""
    return (F.lit(seed * 1000003).cast("long") + visit * 1003 + detector).bitwiseAND(F.lit(UINT32).cast("long"))


def diagnostics(pairs: dict[str, Column]) -> Column:
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs.items()])
