"""All queries of the image-detection engine and their SQL, by name."""

from __future__ import annotations

from lumenframe.plans import catalog_queries, object_queries, pixel_queries, raster_queries  # noqa: F401
from lumenframe.plans.registry import LATER, ORACLES, QUERIES

ORACLES.update({name: sql() for name, sql in LATER.items()})

FLAGSHIP = "a05_pixel_sweep"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
