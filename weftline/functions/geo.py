"""Distances on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance of two points in degrees, in the unit of the radius."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((phi2 - phi1) / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is 0 or missing."""
    return F.when(den != 0, num / F.nullif(den, F.lit(0))).otherwise(F.lit(0.0))
