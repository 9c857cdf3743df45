"""Coordinate systems: degrees, spherical web mercator and transverse mercator (UTM), both ways.

Every formula is written once over a set of functions, so that it works on
columns (``COLUMNS``) and on arrays inside a task (``ARRAYS``). Datums aren't
shifted: NAD83 and WGS84 degrees are taken for the same, which they are to
about a metre or two.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import EARTH_RADIUS

#: Axis and flattening of the GRS80 ellipsoid (WGS84's differs in the 9th digit of the flattening), and UTM's scale and offsets.
AXIS, INVERSE_FLATTENING = 6378137.0, 298.257222101
WGS84_INVERSE_FLATTENING = 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0

COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, sinh=F.sinh, cosh=F.cosh, asin=F.asin, atan=F.atan, atan2=F.atan2, atanh=F.atanh, exp=F.exp, log=F.log, sqrt=F.sqrt, radians=F.radians, degrees=F.degrees)
ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, atanh=np.arctanh, exp=np.exp, log=np.log, sqrt=np.sqrt, radians=np.radians, degrees=np.degrees)


@dataclass(frozen=True)
class Srs:
    """A coordinate system. ``lon0`` may be a column, for a table whose rows have zones of their own."""

    kind: str  # degrees, mercator or transverse
    lon0: float | Column = 0.0
    lat0: float = 0.0
    scale: float = 1.0
    east: float | Column = 0.0
    north: float | Column = 0.0
    axis: float = AXIS
    inverse_flattening: float = INVERSE_FLATTENING


DEGREES, MERCATOR = Srs("degrees"), Srs("mercator")


def utm(zone: int | Column, south: bool | Column = False, inverse_flattening: float = INVERSE_FLATTENING) -> Srs:
    """The system of a UTM zone; of the zone in each row if it is a column."""
    if isinstance(south, Column):
        north = F.when(south, F.lit(UTM_SOUTH)).otherwise(F.lit(0.0))
    else:
        north = UTM_SOUTH if south else 0.0
    return Srs("transverse", zone * 6.0 - 183.0, 0.0, UTM_SCALE, UTM_EAST, north, AXIS, inverse_flattening)


def parse(text: str) -> Srs:
    """The system of "EPSG:<code>" or of a .prj's text; an error for any other than degrees, web mercator and transverse mercator."""
    found = re.fullmatch(r"\s*(?i:EPSG:)\s*(\d+)\s*", text)
    if found:
        code = int(found[1])
        if code in (4326, 4269):
            return DEGREES
        if code in (3857, 900913):
            return MERCATOR
        if 32601 <= code <= 32660 or 32701 <= code <= 32760:
            return utm(code % 100, code > 32700, WGS84_INVERSE_FLATTENING)
        if 26901 <= code <= 26923:
            return utm(code % 100)
        raise ValueError(f"unknown coordinate system {text}")
    flat = re.sub(r"\s+", "", text).upper()
    if flat.startswith("GEOGCS["):
        return DEGREES
    if "PROJECTION[" not in flat:
        raise ValueError(f"unknown coordinate system {text[:60]}")
    value = lambda name, other: float(m[1]) if (m := re.search(rf'PARAMETER\["{name}",([-+0-9.E]+)\]', flat)) else other
    way = re.search(r'PROJECTION\["([^"]+)"', flat)[1]
    if "MERCATOR_AUXILIARY_SPHERE" in way or "PSEUDO" in flat or "POPULARVISUALISATION" in way.replace("_", ""):
        return MERCATOR
    unit = re.search(r'UNIT\["[^"]*",([-+0-9.E]+)[^\]]*\](?:,AUTHORITY\[[^\]]*\])?(?:,AXIS\[[^\]]*\])*(?:,AUTHORITY\[[^\]]*\])?\]$', flat)
    if way != "TRANSVERSE_MERCATOR" or unit and abs(float(unit[1]) - 1) > 1e-9:
        raise ValueError(f"unknown projection {way}")
    body = re.search(r'SPHEROID\["[^"]*",([0-9.E+-]+),([0-9.E+-]+)', flat)
    axis, inverse = (float(body[1]), float(body[2])) if body else (AXIS, INVERSE_FLATTENING)
    return Srs("transverse", value("CENTRAL_MERIDIAN", 0.0), value("LATITUDE_OF_ORIGIN", 0.0), value("SCALE_FACTOR", 1.0), value("FALSE_EASTING", 0.0), value("FALSE_NORTHING", 0.0), axis, inverse)


def _powers(n: float) -> SimpleNamespace:
    """Krueger's series to the fourth power of the third flattening: fixed coefficients."""
    return SimpleNamespace(
        alpha=(
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ),
        beta=(
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ),
        delta=(
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        ),
    )


def _ellipsoid(srs: Srs) -> tuple[float, float, SimpleNamespace]:
    """(third flattening, scaled radius of the rectifying circle, the series)."""
    n = 1 / (2 * srs.inverse_flattening - 1)
    return n, srs.scale * srs.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64), _powers(n)


def _from_equator(srs: Srs) -> float:
    """Metres on the central meridian from the equator to the latitude of origin."""
    return 0.0 if srs.lat0 == 0 else float(_transverse(np.float64(0.0), np.radians(np.float64(srs.lat0)), srs, ARRAYS)[1])


def _transverse(lon, lat, srs: Srs, m):
    """Radians from the central meridian, and of latitude, to metres from the meridian and the equator."""
    n, radius, series = _ellipsoid(srs)
    e = 2 * n**0.5 / (1 + n)
    s = m.sin(lat)
    turned = m.atanh(s) - e * m.atanh(e * s)
    t = m.sinh(turned)
    xi, eta = m.atan2(t, m.cos(lon)), m.atanh(m.sin(lon) / m.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(series.alpha, 1):
        x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return radius * x, radius * y


def forward(lon, lat, srs: Srs, m=COLUMNS):
    """Degrees to the system's (x, y)."""
    if srs.kind == "degrees":
        return lon, lat
    if srs.kind == "mercator":
        return EARTH_RADIUS * m.radians(lon), EARTH_RADIUS * m.log(m.tan(np.pi / 4 + m.radians(lat) / 2))
    x, y = _transverse(m.radians(lon - srs.lon0), m.radians(lat), srs, m)
    return x + srs.east, y - _from_equator(srs) + srs.north


def inverse(x, y, srs: Srs, m=COLUMNS):
    """The system's (x, y) to degrees."""
    if srs.kind == "degrees":
        return x, y
    if srs.kind == "mercator":
        return m.degrees(x / EARTH_RADIUS), m.degrees(2 * m.atan(m.exp(y / EARTH_RADIUS)) - np.pi / 2)
    _, radius, series = _ellipsoid(srs)
    xi0, eta0 = (y - srs.north + _from_equator(srs)) / radius, (x - srs.east) / radius
    xi, eta = xi0, eta0
    for j, b in enumerate(series.beta, 1):
        xi = xi - b * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
        eta = eta - b * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    lat = chi
    for j, d in enumerate(series.delta, 1):
        lat = lat + d * m.sin(2 * j * chi)
    return m.degrees(m.atan2(m.sinh(eta), m.cos(xi))) + srs.lon0, m.degrees(lat)


def between(x, y, source: Srs, target: Srs, m=COLUMNS):
    """(x, y) of one system in another."""
    return (x, y) if source == target else forward(*inverse(x, y, source, m), target, m)
