"""Geodesy and turn costs as Column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6372797.560856
#: Fixed values of the projection: GRS 80, central meridian, scale, offsets.
A, FLAT = 6378137.0, 1 / 298.257222101
LON0, K0, FALSE_E, FALSE_N = 19.0, 0.9993, 500000.0, -5300000.0
#: Fixed values of lower bounds: metres for a degree.
LON_M, LAT_M = 60000.0, 110000.0
#: Fixed values of turns: penalty, slope, bias, U-turn.
TURN_S, BIAS, U_TURN_S = 7.5, 1.075, 20.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def series() -> tuple[float, list[float]]:
    """The rectifying radius and the forward series' coefficients, from the third flattening."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of a transverse Mercator projection, by its series."""
    radius, c = series()
    e = math.sqrt(FLAT * (2 - FLAT))
    phi, dl = F.radians(lat), F.radians(lon - LON0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.sqrt(t * t + F.pow(F.cos(dl), 2)))
    x, y = eta, xi
    for j, a in enumerate(c, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_E + K0 * radius * x, FALSE_N + K0 * radius * y


def inverse_series() -> list[float]:
    """The inverse series' coefficients, from the third flattening."""
    n = FLAT / (2 - FLAT)
    return [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]


def latitude_series() -> list[float]:
    """Coefficients of the geodetic latitude by the conformal one."""
    n = FLAT / (2 - FLAT)
    return [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing: the inverse of project()."""
    radius, _ = series()
    xi0, eta0 = (y - FALSE_N) / (K0 * radius), (x - FALSE_E) / (K0 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(inverse_series(), 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    # the conformal latitude, and by a series the geodetic one
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(latitude_series(), 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.lit(LON0) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def box_gap_m(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """A lower bound of the distance of two boxes (min lon, min lat, max lon, max lat)."""
    gap = lambda lo1, hi1, lo2, hi2: F.greatest(F.lit(0.0), lo2 - hi1, lo1 - hi2)
    return F.hypot(gap(a[0], a[2], b[0], b[2]) * LON_M, gap(a[1], a[3], b[1], b[3]) * LAT_M)


def turn_penalty(angle: Column, u_turn: Column) -> Column:
    """Seconds: a logistic function of the angle, steeper to one side; a U-turn adds a constant."""
    right = TURN_S / (1 + F.exp(-((13 / BIAS) * angle / 180 - 6.5 * BIAS)))
    left = TURN_S / (1 + F.exp(-((13 * BIAS) * -angle / 180 - 6.5 / BIAS)))
    return F.when(angle >= 0, right).otherwise(left) + F.when(u_turn, U_TURN_S).otherwise(0.0)
