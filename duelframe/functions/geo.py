"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.8


def great_circle_miles(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance between two points given in degrees."""
    half_lat = F.sin((F.radians(lat_b) - F.radians(lat_a)) / 2)
    half_lon = F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(chord))
