"""Locations and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treemend.functions.values import to_number
from treemend.model import NULL_NUMBER

# Fixed value: mean earth radius in metres.
EARTH_RADIUS = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def coordinate(text: Column) -> Column:
    number = to_number(text)
    return F.when(number != NULL_NUMBER, number)


def resolve_location(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Usable (lat, lon) from text; both null unless both are usable."""
    lat = coordinate(latitude)
    lat = F.when((lat > -90) & (lat < 90), lat)
    lon = coordinate(longitude)
    both = lat.isNotNull() & lon.isNotNull()
    return F.when(both, lat), F.when(both, lon)
