"""Map projections of degrees to metres, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the offsets of the regional Mercator map.
A, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
MERCATOR_X0, MERCATOR_Y0 = 989634.3811336625, -3512473.95569
SATELLITE_LON, SATELLITE_LAT, SATELLITE_HEIGHT = 17.5, 36.4, 6779000.0
#: Robinson's table: parallel length and distance from the equator at every fifth degree.
ROBINSON_X = (1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322)
ROBINSON_Y = (0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0)
EQUAL_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)


def _newton(start: Column, value, slope, steps: int) -> Column:
    """A fixed number of Newton steps, inside one expression."""
    counter = F.array(*[F.lit(i) for i in range(steps)])
    return F.aggregate(counter, start, lambda x, _: F.when(F.abs(slope(x)) < 1e-12, x).otherwise(x - value(x) / slope(x)))


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda's variable is not expanded where it is named again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi, e = F.radians(lat), ECCENTRICITY
    y = F.log(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2)))
    return F.radians(lon) * A + MERCATOR_X0, y * A + MERCATOR_Y0


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    t, e = F.exp(-(y - MERCATOR_Y0) / A), ECCENTRICITY
    start = math.pi / 2 - 2 * F.atan(t)
    steps = F.array(*[F.lit(i) for i in range(8)])
    phi = F.aggregate(steps, start, lambda p, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))))
    return F.degrees((x - MERCATOR_X0) / A), F.degrees(phi)


def spherical_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * A


def cylindrical(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.radians(lat) * A


def degrees(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * 1.0, lat * 1.0


def mollweide(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    target = math.pi * F.sin(phi)
    theta = _newton(phi * 1.0, lambda x: 2 * x + F.sin(2 * x) - target, lambda x: 2 + 2 * F.cos(2 * x), 25)
    return 2 * math.sqrt(2) / math.pi * A * F.radians(lon) * F.cos(theta), math.sqrt(2) * A * F.sin(theta)


def orthographic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Seen from over 0 N 0 E; points behind the horizon are null."""
    phi, lam = F.radians(lat), F.radians(lon)
    seen = F.cos(phi) * F.cos(lam) >= 0
    n = A / F.sqrt(1 - ECCENTRICITY**2 * F.sin(phi) * F.sin(phi))
    return F.when(seen, n * F.cos(phi) * F.sin(lam)), F.when(seen, n * (1 - ECCENTRICITY**2) * F.sin(phi))


def robinson(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Table values between five-degree parallels are interpolated linearly."""
    size = F.abs(lat) / 5
    at = F.least(F.floor(size), F.lit(17)).cast("int")
    part = size - at
    xs, ys = (F.array(*[F.lit(v) for v in t]) for t in (ROBINSON_X, ROBINSON_Y))
    x = F.get(xs, at) * (1 - part) + F.get(xs, at + 1) * part
    y = F.get(ys, at) * (1 - part) + F.get(ys, at + 1) * part
    return 0.8487 * A * x * F.radians(lon), 1.3523 * A * y * F.signum(lat)


def satellite(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Near-side perspective of the sphere; points behind the horizon are null."""
    phi, lam = F.radians(lat), F.radians(lon - SATELLITE_LON)
    phi0 = math.radians(SATELLITE_LAT)
    p = 1 + SATELLITE_HEIGHT / A
    cosine = math.sin(phi0) * F.sin(phi) + math.cos(phi0) * F.cos(phi) * F.cos(lam)
    k = (p - 1) / (p - cosine)
    x = A * k * F.cos(phi) * F.sin(lam)
    y = A * k * (math.cos(phi0) * F.sin(phi) - math.sin(phi0) * F.cos(phi) * F.cos(lam))
    return F.when(cosine >= 1 / p, x), F.when(cosine >= 1 / p, y)


def eckert_iv(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    target = (2 + math.pi / 2) * F.sin(phi)
    theta = _newton(phi / 2, lambda x: x + F.sin(x) * F.cos(x) + 2 * F.sin(x) - target, lambda x: 1 + F.cos(2 * x) + 2 * F.cos(x), 25)
    scale = 2 / math.sqrt(math.pi * (4 + math.pi))
    return scale * A * F.radians(lon) * (1 + F.cos(theta)), 2 * math.sqrt(math.pi / (4 + math.pi)) * A * F.sin(theta)


def equal_earth(lon: Column, lat: Column) -> tuple[Column, Column]:
    """On the sphere of equal area."""
    e2 = ECCENTRICITY**2
    qp = 1 + (1 - e2) / (2 * ECCENTRICITY) * math.log((1 + ECCENTRICITY) / (1 - ECCENTRICITY))
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - ECCENTRICITY * s) / (1 + ECCENTRICITY * s)) / (2 * ECCENTRICITY))
    radius = A * math.sqrt(qp / 2)
    theta = F.asin(math.sqrt(3) / 2 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / qp)))
    a1, a2, a3, a4 = EQUAL_EARTH
    t2 = theta * theta
    t6 = t2 * t2 * t2
    slope = a1 + 3 * a2 * t2 + t6 * (7 * a3 + 9 * a4 * t2)
    return radius * 2 * math.sqrt(3) * F.radians(lon) * F.cos(theta) / (3 * slope), radius * theta * (a1 + a2 * t2 + t6 * (a3 + a4 * t2))


def _asin(x: Column) -> Column:
    """asin of what rounding may have put a little beyond 1; null stays null."""
    return F.when(x.isNotNull(), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))


def degrees_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 1.0, y * 1.0


def spherical_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def cylindrical_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(y / A)


def mollweide_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    theta = _asin(y / (math.sqrt(2) * A))
    return F.degrees(x * math.pi / (2 * math.sqrt(2) * A * F.cos(theta))), F.degrees(_asin((2 * theta + F.sin(2 * theta)) / math.pi))


def orthographic_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    e2 = ECCENTRICITY**2
    s = y / F.sqrt((A * (1 - e2)) ** 2 + e2 * y * y)
    n = A / F.sqrt(1 - e2 * s * s)
    return F.degrees(_asin(x / (n * F.sqrt(1 - s * s)))), F.degrees(_asin(s))


def robinson_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """The table is read the other way: the five degrees whose distances from the equator hold y."""
    size = F.abs(y) / (1.3523 * A)
    ys, xs = (F.array(*[F.lit(v) for v in t]) for t in (ROBINSON_Y, ROBINSON_X))
    at = F.least(F.size(F.filter(ys, lambda v: v <= size)) - 1, F.lit(17))
    part = (size - F.get(ys, at)) / (F.get(ys, at + 1) - F.get(ys, at))
    length = F.get(xs, at) * (1 - part) + F.get(xs, at + 1) * part
    return F.degrees(x / (0.8487 * A * length)), 5 * (at + part) * F.signum(y)


def satellite_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Null beyond the horizon's circle; beyond the pole longitudes go on from -180 degrees."""
    phi0, p = math.radians(SATELLITE_LAT), 1 + SATELLITE_HEIGHT / A
    rho = F.sqrt(x * x + y * y)
    under = 1 - rho * rho * (p + 1) / (A * A * (p - 1))
    c = _asin((p - F.sqrt(F.when(under >= -1e-12, F.greatest(under, F.lit(0.0))))) / (A * (p - 1) / rho + rho / (A * (p - 1))))
    lat = _asin(F.cos(c) * math.sin(phi0) + y * F.sin(c) * math.cos(phi0) / rho)
    lam = F.atan2(x * F.sin(c), rho * math.cos(phi0) * F.cos(c) - y * math.sin(phi0) * F.sin(c))
    centre = rho == 0
    lon = _bound(SATELLITE_LON + F.degrees(lam), lambda d: F.when(d > 180, d - 360).otherwise(d))
    return F.when(centre, F.lit(SATELLITE_LON)).otherwise(lon), F.when(centre, F.lit(SATELLITE_LAT)).otherwise(F.degrees(lat))


def eckert_iv_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    theta = _asin(y / (2 * math.sqrt(math.pi / (4 + math.pi)) * A))
    scale = 2 / math.sqrt(math.pi * (4 + math.pi))
    return F.degrees(x / (scale * A * (1 + F.cos(theta)))), F.degrees(_asin((theta + F.sin(theta) * F.cos(theta) + 2 * F.sin(theta)) / (2 + math.pi / 2)))


def equal_earth_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Newton's method for the map's angle, and again for the latitude of the same area on the ellipsoid."""
    e, e2 = ECCENTRICITY, ECCENTRICITY**2
    qp = 1 + (1 - e2) / (2 * e) * math.log((1 + e) / (1 - e))
    radius = A * math.sqrt(qp / 2)
    a1, a2, a3, a4 = EQUAL_EARTH
    slope = lambda t: a1 + 3 * a2 * t * t + F.pow(t, F.lit(6)) * (7 * a3 + 9 * a4 * t * t)
    shape = lambda t: t * (a1 + a2 * t * t + F.pow(t, F.lit(6)) * (a3 + a4 * t * t))
    theta = _bound(y / radius, lambda h: _newton(h, lambda t: shape(t) - h, slope, 12))
    area = lambda p: (1 - e2) * (F.sin(p) / (1 - e2 * F.sin(p) * F.sin(p)) - F.log((1 - e * F.sin(p)) / (1 + e * F.sin(p))) / (2 * e))
    steep = lambda p: 2 * (1 - e2) * F.cos(p) / F.pow(1 - e2 * F.sin(p) * F.sin(p), F.lit(2))
    # The angle is bound before the second search, whose every step would else make the first one again.
    phi = _bound(qp * 2 / math.sqrt(3) * F.sin(theta), lambda target: _newton(_asin(target / qp), lambda p: area(p) - target, steep, 8))
    return F.degrees(_bound(theta, lambda t: x * 3 * slope(t) / (radius * 2 * math.sqrt(3) * F.cos(t)))), F.degrees(phi)


PROJECTIONS = {
    "degrees": degrees, "mercator": mercator, "cylindrical": cylindrical, "google": spherical_mercator, "mollweide": mollweide,
    "orthographic": orthographic, "robinson": robinson, "satellite": satellite, "eckert iv": eckert_iv, "equal earth": equal_earth, "epsg 3857": spherical_mercator,
}


INVERSES = {
    "degrees": degrees_inverse, "mercator": mercator_inverse, "cylindrical": cylindrical_inverse, "google": spherical_mercator_inverse, "mollweide": mollweide_inverse,
    "orthographic": orthographic_inverse, "robinson": robinson_inverse, "satellite": satellite_inverse, "eckert iv": eckert_iv_inverse,
    "equal earth": equal_earth_inverse, "epsg 3857": spherical_mercator_inverse,
}


def unproject(name: str, x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a named projection's metres; null where the map shows nothing."""
    return INVERSES[name.lower()](x, y)


def project(name: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of a named projection (degrees stay degrees)."""
    return PROJECTIONS[name.lower()](lon, lat)


def coriolis(lat: Column, omega: float = 7.2921e-5) -> Column:
    return 2 * omega * F.sin(F.radians(lat))
