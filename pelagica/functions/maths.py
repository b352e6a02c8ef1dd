"""Rounding, vector and distance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius used for great-circle distances, in metres.
EARTH_RADIUS_M = 6_371_000.0


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half_even(value: Column | str, digits: int = 0) -> Column:
    """Round half to even.

    The value is first snapped to eight digits so that a sum taken in another
    order, off by one unit in the last place, rounds the same way.
    """
    scale = F.lit(float(10**digits))
    return F.rint(F.round(_col(value), 8) * scale) / scale


def nan_to_null(value: Column | str) -> Column:
    """NaN and infinities to NULL."""
    value = _col(value)
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def vector_sum(x: Column | str, y: Column | str, z: Column | str, factor: float = 1.0) -> Column:
    """Length of a three-axis vector, optionally scaled."""
    x, y, z = _col(x), _col(y), _col(z)
    length = F.sqrt(x * x + y * y + z * z)
    return length if factor == 1.0 else length * F.lit(factor)


def wrap360(lon: Column | str) -> Column:
    """Longitude from -180..180 to 0..360."""
    lon = _col(lon)
    return F.when(lon < 0, lon + F.lit(360.0)).otherwise(lon)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle (haversine) distance in metres."""
    dlat = F.radians(lat2 - lat1) / F.lit(2.0)
    dlon = F.radians(lon2 - lon1) / F.lit(2.0)
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        dlon
    ) * F.sin(dlon)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def distinct_with_null(value: Column | str) -> Column:
    """Distinct count in which NULL counts as one more value."""
    value = _col(value)
    missing = F.max(F.when(value.isNull(), F.lit(1)).otherwise(F.lit(0)))
    return F.countDistinct(value) + F.coalesce(missing, F.lit(0))
