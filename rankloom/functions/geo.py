"""Distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Great-circle distance in km between two points in degrees."""
    half_lat = F.sin(F.radians(other_lat - lat) / 2)
    half_lon = F.sin(F.radians(other_lon - lon) / 2)
    inner = half_lat * half_lat + F.cos(F.radians(lat)) * F.cos(
        F.radians(other_lat)
    ) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(inner))


def east_km(lon: Column, reference_lat: Column) -> Column:
    """Local equirectangular x about a reference latitude."""
    return F.radians(lon) * F.lit(EARTH_RADIUS_KM) * F.cos(F.radians(reference_lat))


def north_km(lat: Column) -> Column:
    """Local equirectangular y."""
    return F.radians(lat) * F.lit(EARTH_RADIUS_KM)
