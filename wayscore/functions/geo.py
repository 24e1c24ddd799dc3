"""Great-circle distances as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayscore.fixed import EARTH_RADIUS_KM


def unit_clamp(value: Column) -> Column:
    """``value`` held within [0, 1]; NULL and NaN become 0."""
    known = F.nanvl(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), known))


def _haversine(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    rise = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    run = F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return unit_clamp(rise + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * run)


def distance_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Distance of two points in km; 0.0 if a coordinate is NULL or NaN."""
    h = _haversine(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(h), F.sqrt(1 - h)) * (2 * radius)


def distance_km_asin(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """The same distance through the arc sine."""
    return F.asin(F.sqrt(_haversine(lat1, lon1, lat2, lon2))) * (2 * radius)


def located(*coordinates) -> Column:
    """True if every coordinate is a number, neither NULL nor NaN."""
    known = F.lit(True)
    for c in coordinates:
        c = F.col(c) if isinstance(c, str) else c
        known = known & c.isNotNull() & ~F.isnan(c)
    return known


def at_origin(lat="latitude", lon="longitude") -> Column:
    """True for the (0, 0) fix a receiver reports when it has no position.

    Never NULL, so that the flag and its negation split a table completely.
    """
    return F.coalesce((F.col(lat) == 0.0) & (F.col(lon) == 0.0), F.lit(False))
