"""Projections by EPSG code, forward and back, as column expressions or on arrays.

The same formulas serve both: ``m`` is the module whose sin, log and so on they use, ``columns`` or ``arrays``. Degrees on one side,
metres on the other. Systems on WGS84, ETRS89 and NAD83 are taken for one datum, which is right to about a metre.
"""

from __future__ import annotations

import math
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
from pyspark.sql import functions as F

columns = SimpleNamespace(**{n: getattr(F, n) for n in ("sin", "cos", "tan", "asin", "atan", "atan2", "sinh", "cosh", "tanh", "atanh", "sqrt", "exp", "radians", "degrees", "pow")}, log=F.ln)
arrays = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, tanh=np.tanh, atanh=np.arctanh, sqrt=np.sqrt, exp=np.exp, radians=np.radians, degrees=np.degrees, pow=np.power, log=np.log
)

#: The ellipsoids of WGS84 and GRS80.
A, WGS84, GRS80 = 6378137.0, 1 / 298.257223563, 1 / 298.257222101
#: EPSG code to standard parallels, origin (latitude, longitude), false easting and northing of conformal conics.
CONICS = {2154: (49.0, 44.0, 46.5, 3.0, 700000.0, 6600000.0), 3034: (35.0, 65.0, 52.0, 10.0, 4000000.0, 2800000.0), 3347: (49.0, 77.0, 63.390675, -91.0 - 52.0 / 60, 6200000.0, 3000000.0)}


class Transverse(NamedTuple):
    lon0: float
    easting: float
    northing: float
    flattening: float
    k: float = 0.9996


def transverse(epsg: int) -> Transverse | None:
    """The transverse Mercator projection of a zone: WGS84 north (326..) and south (327..), ETRS89 (258..) and NAD83 (269..)."""
    family, zone = divmod(epsg, 100)
    if not (family in (326, 327) and 1 <= zone <= 60 or family == 258 and 28 <= zone <= 38 or family == 269 and 1 <= zone <= 23):
        return None
    return Transverse(zone * 6 - 183.0, 5e5, 1e7 if family == 327 else 0.0, WGS84 if family in (326, 327) else GRS80)


def known(epsg: int) -> bool:
    return epsg in (4326, 3857) or epsg in CONICS or transverse(epsg) is not None


def _conformal(phi, e: float, m):
    """Tangent of the conformal latitude."""
    return m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))


def _latitude(chi, e: float, m):
    """The latitude of a conformal one, by its series in the eccentricity; to about 1e-11."""
    e2 = e * e
    terms = (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280,
    )
    return chi + sum(c * m.sin(2 * k * chi) for k, c in enumerate(terms, 1))


def _series(f: float) -> tuple[float, float, tuple[float, ...], tuple[float, ...]]:
    n = f / (2 - f)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return math.sqrt(f * (2 - f)), radius, there, back


def _conic(epsg: int) -> tuple[float, float, float, float]:
    """Eccentricity, exponent, scale and radius of the origin's parallel."""
    p1, p2, p0 = (math.radians(v) for v in CONICS[epsg][:3])
    e = math.sqrt(GRS80 * (2 - GRS80))
    wide = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.exp(-(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p))))
    n = math.log(wide(p1) / wide(p2)) / math.log(t(p1) / t(p2))
    scale = A * wide(p1) / (n * t(p1) ** n)
    return e, n, scale, scale * t(p0) ** n


def forward(lon, lat, epsg: int, m=arrays):
    """(x, y) of degrees."""
    if epsg == 4326:
        return lon, lat
    lam, phi = m.radians(lon), m.radians(lat)
    if epsg == 3857:
        return A * lam, A * m.log(m.tan(math.pi / 4 + phi / 2))
    if epsg in CONICS:
        e, n, scale, origin = _conic(epsg)
        rho = scale * m.exp(-n * (m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi))))
        theta = n * (lam - math.radians(CONICS[epsg][3]))
        return CONICS[epsg][4] + rho * m.sin(theta), CONICS[epsg][5] + origin - rho * m.cos(theta)
    if (t := transverse(epsg)) is None:
        raise ValueError(f"EPSG:{epsg} is not known")
    e, radius, there, _ = _series(t.flattening)
    lam = m.radians(lon - t.lon0)
    tau = _conformal(phi, e, m)
    xi, eta = m.atan2(tau, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + tau * tau))
    x = eta + sum(c * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, c in enumerate(there, 1))
    y = xi + sum(c * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, c in enumerate(there, 1))
    return t.easting + t.k * radius * x, t.northing + t.k * radius * y


def inverse(x, y, epsg: int, m=arrays):
    """(lon, lat) in degrees."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return m.degrees(x / A), m.degrees(2 * m.atan(m.exp(y / A)) - math.pi / 2)
    if epsg in CONICS:
        e, n, scale, origin = _conic(epsg)
        east, south = x - CONICS[epsg][4], origin - (y - CONICS[epsg][5])
        rho = m.sqrt(east * east + south * south)
        chi = math.pi / 2 - 2 * m.atan(m.pow(rho / scale, 1 / n))
        return CONICS[epsg][3] + m.degrees(m.atan2(east, south) / n), m.degrees(_latitude(chi, e, m))
    if (t := transverse(epsg)) is None:
        raise ValueError(f"EPSG:{epsg} is not known")
    e, radius, _, back = _series(t.flattening)
    xi, eta = (y - t.northing) / (t.k * radius), (x - t.easting) / (t.k * radius)
    u = xi - sum(c * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, c in enumerate(back, 1))
    v = eta - sum(c * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, c in enumerate(back, 1))
    return t.lon0 + m.degrees(m.atan2(m.sinh(v), m.cos(u))), m.degrees(_latitude(m.asin(m.sin(u) / m.cosh(v)), e, m))


def between(source: int, target: int, x, y, m=arrays):
    """Coordinates of one system in another."""
    if source == target:
        return x, y
    return forward(*inverse(x, y, source, m), target, m)
