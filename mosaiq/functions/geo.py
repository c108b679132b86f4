"""Distances and map projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def mercator_y(lat: Column) -> Column:
    """0 at the north end of the web map and 1 at its south end."""
    r = F.radians(lat)
    return (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2


def mercator_latitude(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y))))


def near_home(lat: Column, lon: Column, home: tuple[float, float], km: float) -> Column:
    """Rows to keep when trips are left out: without a place, or within the distance."""
    return lat.isNull() | lon.isNull() | (haversine_km(lat, lon, F.lit(home[0]), F.lit(home[1])) < km)


def away(lat: Column, lon: Column, home: tuple[float, float], km: float) -> Column:
    """Rows with a place at the distance or beyond."""
    return lat.isNotNull() & lon.isNotNull() & (haversine_km(lat, lon, F.lit(home[0]), F.lit(home[1])) >= km)
