"""Geometry and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2) * 1000


def polygon_area_m2(points: Column) -> Column:
    """Shoelace over radians of an array<struct<lat,lng>>; no cosine term; under three points: 0."""
    n, r = F.size(points), EARTH_KM * 1000
    turned = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: F.radians(p["lng"]) * F.radians(q["lat"]) - F.radians(q["lng"]) * F.radians(p["lat"]))
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) * (r * r / 2))


def polygon_perimeter_m(points: Column) -> Column:
    """Length of the closed ring."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, turned, lambda p, q: distance_m(p["lat"], p["lng"], q["lat"], q["lng"])), F.lit(0.0), lambda a, x: a + x)


def valid_latlng(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def in_country_bounds(lat: Column, lng: Column) -> Column:
    return lat.between(6, 37) & lng.between(68, 98)


def decimals(value: Column) -> Column:
    """Decimal places without trailing zeros, eight at most."""
    text = F.rtrim(F.substring_index(value.cast("decimal(18,8)").cast("string"), ".", -1), F.lit("0"))
    return F.length(text)


def adequate_precision(lat: Column, lng: Column) -> Column:
    return F.least(decimals(lat), decimals(lng)) >= 4


def spatial_accuracy_m(lat: Column, lng: Column) -> Column:
    """Metres that the coarser coordinate's last decimal place stands for, six places at most."""
    steps = F.array(*[F.lit(v) for v in (111000.0, 11100.0, 1110.0, 111.0, 11.1, 1.11, 0.111)])
    return F.element_at(steps, F.least(F.least(decimals(lat), decimals(lng)), F.lit(6)) + 1)


#: State boxes (name, south, north, west, east), the first that holds a point wins.
STATE_BOXES = (("MP", 21.5, 26.0, 74.0, 82.5), ("Telangana", 17.0, 19.5, 77.0, 81.5), ("Odisha", 17.5, 22.5, 81.5, 87.5), ("Tripura", 22.5, 24.5, 91.0, 92.5))


def containing_state(lat: Column, lng: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, south, north, west, east in reversed(STATE_BOXES):
        out = F.when(lat.between(south, north) & lng.between(west, east), name).otherwise(out)
    return out


def coordinate_text(text: Column) -> Column:
    """struct<lat,lng> of "lat,lng", null unless both are numbers in range."""
    parts = F.split(text, ",")
    lat, lng = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.when(valid_latlng(lat, lng) & (F.size(parts) == 2), F.struct(lat.alias("lat"), lng.alias("lng")))


# Transverse Mercator by Krüger's series in the third flattening, WGS84.
_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0 = 0.9996
_E = 2 * _N**0.5 / (1 + _N)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lat: Column, lng: Column, zone: Column) -> Column:
    """struct<x,y>: easting and northing in metres on the northern half; zone is a number."""
    phi, lam = F.radians(lat), F.radians(lng - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + _K0 * _A * x).alias("x"), (_K0 * _A * y).alias("y"))


def from_utm(x: Column, y: Column, zone: Column) -> Column:
    """struct<lat,lng> in degrees of a point of the northern half."""
    xi, eta = y / (_K0 * _A), (x - 500000) / (_K0 * _A)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183)).alias("lng"))


def utm_zone(lng: Column) -> Column:
    """43, 44 or 45, whichever is nearest."""
    return F.when(lng < 78, 43).when(lng < 84, 44).otherwise(45)
