"""Coordinates in text as column expressions: six notations in a fixed order, and UTM without a projection library."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notations, in the order in which they are tried.
DECIMAL_DEGREES = r"(?i)(\d+\.?\d*)\s*[°\s]*([NSEW])\s*,?\s*(\d+\.?\d*)\s*[°\s]*([NSEW])"
DMS = r"""(?i)(\d+)°\s*(\d+)'\s*(\d+\.?\d*)"\s*([NSEW])\s*,?\s*(\d+)°\s*(\d+)'\s*(\d+\.?\d*)"\s*([NSEW])"""
UTM = r"(?i)(\d{6,7})\s*[Ee]\s*,?\s*(\d{7,8})\s*[Nn]"
TOWNSHIP_RANGE = r"(?i)T(\d+)\s*[Nn]\s*R(\d+)\s*[EW]?\s*,?\s*Section\s*(\d+)"
DECIMAL_SIMPLE = r"(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)"
STATE_PLANE = r"(?i)(\d+\.?\d*)\s*[Ee]\s*,?\s*(\d+\.?\d*)\s*[Nn]"
UTM_ZONE = r"(?i)Zone\s*(\d+[NS])"
# Fixed value: what marks a text block as holding coordinates.
COORDINATE_BLOCK = r"""(?i)\d+\.\d+[°\s]*[NSEW]|\d+°\s*\d+'\s*\d+\.?\d*"[°\s]*[NSEW]|\d{6,7}\s+\d{7,8}|T\d+N\s*R\d+[EW]|Section\s+\d+"""

FIELDS = ("latitude", "longitude", "easting", "northing", "utm_zone", "township", "range", "section")
_NUMBERS = FIELDS[:4]


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def dms_to_decimal(d: Column, m: Column, s: Column, direction: Column) -> Column:
    v = d + m / 60 + s / 3600
    return F.when(direction.isin("S", "W"), -v).otherwise(v)


def _struct(kind: str, crs: str, confidence: float, **fields: Column) -> Column:
    cols = [F.lit(kind).alias("kind")]
    for f in FIELDS:
        cols.append(fields.get(f, F.lit(None)).cast("double" if f in _NUMBERS else "string").alias(f))
    return F.struct(*cols, F.lit(crs).alias("crs"), F.lit(confidence).alias("confidence"))


def parse(text: Column) -> Column:
    """The first notation that matches and is in range, as a struct; null if none is."""
    t = F.trim(text)
    got = lambda p, g: F.regexp_extract(t, p, g)
    num = lambda p, g: F.nullif(got(p, g), F.lit("")).cast("double")
    lat = F.when(F.upper(got(DECIMAL_DEGREES, 2)) == "N", num(DECIMAL_DEGREES, 1)).otherwise(-num(DECIMAL_DEGREES, 1))
    lon = F.when(F.upper(got(DECIMAL_DEGREES, 4)) == "E", num(DECIMAL_DEGREES, 3)).otherwise(-num(DECIMAL_DEGREES, 3))
    d_lat = dms_to_decimal(num(DMS, 1), num(DMS, 2), num(DMS, 3), F.upper(got(DMS, 4)))
    d_lon = dms_to_decimal(num(DMS, 5), num(DMS, 6), num(DMS, 7), F.upper(got(DMS, 8)))
    s_lat, s_lon = num(DECIMAL_SIMPLE, 1), num(DECIMAL_SIMPLE, 2)
    zone = F.nullif(got(UTM_ZONE, 1), F.lit(""))
    return F.coalesce(
        F.when(t.rlike(DECIMAL_DEGREES) & in_range(lat, lon), _struct("decimal_degrees", "EPSG:4326", 0.9, latitude=lat, longitude=lon)),
        F.when(t.rlike(DMS) & in_range(d_lat, d_lon), _struct("dms", "EPSG:4326", 0.9, latitude=d_lat, longitude=d_lon)),
        F.when(t.rlike(UTM), _struct("utm", "EPSG:32600", 0.8, easting=num(UTM, 1), northing=num(UTM, 2), utm_zone=zone)),
        F.when(
            t.rlike(TOWNSHIP_RANGE),
            _struct("township_range", "US_PLSS", 0.8, township=got(TOWNSHIP_RANGE, 1), range=got(TOWNSHIP_RANGE, 2), section=got(TOWNSHIP_RANGE, 3)),
        ),
        F.when(t.rlike(DECIMAL_SIMPLE) & in_range(s_lat, s_lon), _struct("decimal_simple", "EPSG:4326", 0.7, latitude=s_lat, longitude=s_lon)),
        F.when(t.rlike(STATE_PLANE), _struct("state_plane", "State_Plane", 0.7, easting=num(STATE_PLANE, 1), northing=num(STATE_PLANE, 2))),
    )


# WGS84 and the series of the transverse Mercator projection to the fourth order.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0, _FE, _FN = 0.9996, 500000.0, 1e7
_E = math.sqrt(_F * (2 - _F))
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)


def utm_to_latlon(easting: Column, northing: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees (WGS84)."""
    xi = (northing - F.when(north, 0.0).otherwise(_FN)) / (_K0 * _A)
    eta = (easting - _FE) / (_K0 * _A)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    # Conformal to geographic latitude: a series in the third flattening.
    n = _N
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183)


def latlon_to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (false northing added in the south)."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return _FE + _K0 * _A * y, F.when(lat < 0, _FN).otherwise(0.0) + _K0 * _A * x
