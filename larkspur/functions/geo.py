"""Geographic predicates and distances over latitude and longitude columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES = {"in": 0.0254, "inch": 0.0254, "yd": 0.9144, "yards": 0.9144, "ft": 0.3048, "feet": 0.3048, "km": 1000.0, "kilometers": 1000.0, "nm": 1852.0, "nauticalmiles": 1852.0, "mm": 0.001, "millimeters": 0.001, "cm": 0.01, "centimeters": 0.01, "mi": 1609.344, "miles": 1609.344, "m": 1.0, "meters": 1.0}
TOLERANCE = 1e-6


def metres(text: str | float) -> float:
    """``5km``, ``3.2 mi`` ...; a plain number is metres."""
    m = re.fullmatch(r"\s*([0-9.eE+-]+?)\s*([a-zA-Z]*)\s*", str(text))
    if not m or (m[2] and m[2].lower() not in METRES):
        raise ValueError(f"not a distance: {text}")
    return float(m[1]) * METRES[m[2].lower() or "m"]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) ** 2
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Inside a box, edges included; a left edge east of the right one crosses the date line."""
    high = lat.between(bottom, top)
    return high & ((lon >= left) | (lon <= right)) if left > right else high & lon.between(left, right)


def within(lat: Column, lon: Column, at_lat: float, at_lon: float, distance_m: float) -> Column:
    """Within a distance: a box first, which Parquet statistics can serve, then the great circle."""
    up = math.degrees(distance_m / EARTH_M)
    near = lat.between(at_lat - up, at_lat + up)
    if abs(at_lat) + up < 89.9:
        side = math.degrees(math.asin(min(1.0, math.sin(min(distance_m / EARTH_M, math.pi / 2)) / math.cos(math.radians(at_lat)))))
        left, right = at_lon - side, at_lon + side
        if side < 180:
            near &= in_box(lat, lon, 90, left + 360 if left < -180 else left, -90, right - 360 if right > 180 else right)
    return near & (haversine(lat, lon, F.lit(at_lat), F.lit(at_lon)) <= distance_m)


def in_polygon(lat: Column, lon: Column, points: list[tuple[float, float]]) -> Column:
    """Inside a polygon of (lat, lon) points by ray casting; vertices belong to it."""
    lats, lons = [p[0] for p in points], [p[1] for p in points]
    crossings = F.lit(0)
    on = F.lit(False)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(points, points[1:] + points[:1], strict=True):
        on |= (F.abs(lat - a_lat) <= TOLERANCE) & (F.abs(lon - a_lon) <= TOLERANCE)
        if a_lat != b_lat:
            cut = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
            crossings += (cut & (lon < (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon)).cast("int")
    return in_box(lat, lon, max(lats) + TOLERANCE, min(lons) - TOLERANCE, min(lats) - TOLERANCE, max(lons) + TOLERANCE) & (on | (crossings % 2 == 1))


BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_box(code: str) -> tuple[float, float, float, float]:
    """South, west, north and east edge of a geohash cell."""
    low, high, east = [-90.0, -180.0], [90.0, 180.0], True
    for c in code.lower():
        for bit in (16, 8, 4, 2, 1):
            k = int(east)
            middle = (low[k] + high[k]) / 2
            (low if BASE32.index(c) & bit else high)[k] = middle
            east = not east
    return low[0], low[1], high[0], high[1]
