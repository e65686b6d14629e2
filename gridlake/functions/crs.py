"""Projections from and to WGS84: identity, Web Mercator, and UTM by a Krueger series; as Column expressions or on numpy arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Arrays:
    """numpy under the names that pyspark.sql.functions has; the `m` of the formulas below."""

    radians, degrees, sqrt = np.radians, np.degrees, np.sqrt
    sin, cos, tan, sinh, cosh, asinh = np.sin, np.cos, np.tan, np.sinh, np.cosh, np.arcsinh
    atan, atan2, atanh = np.arctan, np.arctan2, np.arctanh

EARTH_RADIUS = 6378137.0
FLATTENING = {"wgs84": 1 / 298.257223563, "nad83": 1 / 298.257222101}
K0, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0


def zone_of(epsg: int) -> tuple[int, bool, str] | None:
    """(zone, southern, datum) of a UTM code."""
    if 32601 <= epsg <= 32660:
        return epsg - 32600, False, "wgs84"
    if 32701 <= epsg <= 32760:
        return epsg - 32700, True, "wgs84"
    if 26901 <= epsg <= 26923:
        return epsg - 26900, False, "nad83"
    return None


def utm_epsg(lon: Column, lat: Column) -> Column:
    """The WGS84 UTM code of a point."""
    zone = F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + 180) / 6) + 1).cast("int")))
    return zone + F.when(lat >= 0, 32600).otherwise(32700)


def _series(n: float) -> list[float]:
    """Coefficients of the forward series in the third flattening, to its fourth power."""
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]


def mercator(lon, lat, m=F) -> tuple:
    """x and y; a latitude beyond a pole, where the cosine is negative, has no y: NaN."""
    grown = m.tan(m.radians(lat)) + 1 / m.cos(m.radians(lat))
    return m.radians(lon) * EARTH_RADIUS, _log(grown, m) * EARTH_RADIUS


def _log(x, m):
    """The natural logarithm, minus infinity of 0 and NaN below it (Spark's has null for both)."""
    if m is F:
        return F.when(x > 0, F.log(x)).when(x < 0, float("nan")).when(x == 0, float("-inf"))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(x)


def mercator_inverse(x, y, m=F) -> tuple:
    return m.degrees(x / EARTH_RADIUS), m.degrees(m.atan(m.sinh(y / EARTH_RADIUS)))


def utm(lon, lat, zone: int, southern: bool, datum: str = "wgs84", m=F) -> tuple:
    f = FLATTENING[datum]
    n = f / (2 - f)
    radius = EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = math.sqrt(f * (2 - f))
    phi, lam = m.radians(lat), m.radians(lon - (zone * 6 - 183))
    tau = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi, eta = m.atan2(tau, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(tau * tau + m.cos(lam) * m.cos(lam)))
    x, y = eta, xi
    for k, a in enumerate(_series(n), 1):
        x = x + a * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        y = y + a * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
    return K0 * radius * x + FALSE_EASTING, K0 * radius * y + (FALSE_NORTHING if southern else 0.0)


def utm_inverse(x, y, zone: int, southern: bool, datum: str = "wgs84", m=F) -> tuple:
    """Longitude and latitude: the series' terms are taken off by fixed-point steps, and latitude by Newton's method on tau."""
    f = FLATTENING[datum]
    n = f / (2 - f)
    radius = EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = math.sqrt(f * (2 - f))
    north, east = (y - (FALSE_NORTHING if southern else 0.0)) / (K0 * radius), (x - FALSE_EASTING) / (K0 * radius)
    xi, eta = north, east
    for _ in range(4):
        terms = [(a, 2 * k) for k, a in enumerate(_series(n), 1)]
        xi, eta = north - sum(a * m.sin(k * xi) * m.cosh(k * eta) for a, k in terms), east - sum(a * m.cos(k * xi) * m.sinh(k * eta) for a, k in terms)
    lam = m.atan2(m.sinh(eta), m.cos(xi))
    conformal = m.asinh(m.sin(xi) / m.sqrt(m.sinh(eta) * m.sinh(eta) + m.cos(xi) * m.cos(xi)))
    q = conformal
    for _ in range(5):  # q: isometric latitude plus what the ellipsoid takes off
        sine = m.sinh(q) / m.cosh(q)
        q = conformal + e * m.atanh(e * sine)
    return m.degrees(lam) + (zone * 6 - 183), m.degrees(m.atan(m.sinh(q)))


def project(lon, lat, epsg: int | None, m=F) -> tuple:
    """Coordinates in the CRS; no code counts as degrees."""
    return _convert(lon, lat, epsg, m, mercator, utm)


def unproject(x, y, epsg: int | None, m=F) -> tuple:
    """Longitude and latitude of coordinates in the CRS."""
    return _convert(x, y, epsg, m, mercator_inverse, utm_inverse)


def _convert(x, y, epsg: int | None, m, mercator_, utm_) -> tuple:
    if epsg in (None, 4326, 4269):
        return x, y
    if epsg in (3857, 900913):
        return mercator_(x, y, m)
    found = zone_of(epsg)
    if not found:
        raise ValueError(f"EPSG:{epsg} is not supported")
    return utm_(x, y, *found, m)
