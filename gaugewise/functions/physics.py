"""Meteorological and geodesic formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mean Earth radius in km; Magnus coefficients over water.
EARTH_RADIUS_KM = 6371.0
MAGNUS_A = 17.62
MAGNUS_B = 243.12


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def dew_point(temperature: Column, humidity: Column) -> Column:
    """Magnus dew point in °C; NULL for a missing value or a humidity that is not positive."""
    ok = temperature.isNotNull() & (humidity > 0) & (temperature > -MAGNUS_B)
    gamma = F.ln(humidity / 100) + F.lit(MAGNUS_A) * temperature / (temperature + MAGNUS_B)
    return F.when(ok, F.lit(MAGNUS_B) * gamma / (F.lit(MAGNUS_A) - gamma))
