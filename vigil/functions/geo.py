"""Coordinate expressions: distances and grid bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def euclidean(lat1, lon1, lat2, lon2) -> Column:
    """Planar distance in degrees (the validation rule's metric).

    Squares are plain products (correctly rounded), not ``pow``."""
    dy, dx = _c(lat1) - _c(lat2), _c(lon1) - _c(lon2)
    return F.sqrt(dy * dy + dx * dx)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    sp, sl = F.sin((p2 - p1) / 2), F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2)
    a = sp * sp + F.cos(p1) * F.cos(p2) * sl * sl
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def earth_point(lat, lon) -> list[Column]:
    """x, y, z in km on the sphere. The chord between two of them grows with
    their great-circle distance, at the poles and the date line, too."""
    p, q = F.radians(_c(lat)), F.radians(_c(lon))
    return [EARTH_RADIUS_KM * c for c in (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))]


def truncating_bin(x, size: float) -> Column:
    """``int(x / size)``: truncation toward zero, so bin 0 spans (-size, size)."""
    return (_c(x) / F.lit(size)).cast("bigint")


def floor_bin(x, size: float) -> Column:
    """Uniform bucket ``floor(x / size)`` used by the bucketed distance joins."""
    return F.floor(_c(x) / F.lit(size)).cast("bigint")


def valid_point(lat, lon) -> Column:
    """Both coordinates present and not NaN."""
    lat, lon = _c(lat), _c(lon)
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def on_earth(lat, lon) -> Column:
    """A valid point whose latitude lies between the poles; longitudes wrap."""
    return valid_point(lat, lon) & F.coalesce(F.abs(_c(lat)) <= 90, F.lit(False)) & F.coalesce(F.abs(_c(lon)) < 1e9, F.lit(False))
