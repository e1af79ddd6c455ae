"""Distances and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def cell_size(radius_m: float) -> float:
    return max(radius_m / METRES_PER_DEGREE, 1e-5) * 1.5


def cell(x: Column, size: Column | float) -> Column:
    """Truncated toward zero."""
    return (x / size).cast("long")


def area_id(osm_type: Column, osm_id: Column) -> Column:
    """Search area of a boundary; NULL for points."""
    return F.when(osm_type == "relation", osm_id + 3_600_000_000).when(osm_type == "way", osm_id + 2_400_000_000).cast("long")


def bbox_clause(south: Column, north: Column, west: Column, east: Column) -> Column:
    return F.format_string("(%s,%s,%s,%s)", *[c.cast("string") for c in (south, west, north, east)])
