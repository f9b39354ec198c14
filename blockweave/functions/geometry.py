"""Geometry as column expressions: points are x (longitude) and y (latitude) in degrees, rings arrays of (x, y)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

MERCATOR_RADIUS, EARTH_RADIUS = 6378137.0, 6371000.0


def mercator_x(x: Column) -> Column:
    return F.radians(x) * MERCATOR_RADIUS


def mercator_y(y: Column) -> Column:
    return F.ln(F.tan(F.lit(pi / 4) + F.radians(y) / 2)) * MERCATOR_RADIUS


def _once(value: Column, made) -> Column:
    """made(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _pairs(ring: Column, made) -> Column:
    """made(point, next point) for each side of a closed ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), made)


def signed_area(ring: Column) -> Column:
    """Shoelace sum of a closed ring; positive if counter-clockwise."""
    return _once(ring, lambda r: _sum(_pairs(r, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2


def mercator_hectares(ring: Column) -> Column:
    flat = F.transform(ring, lambda p: F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y")))
    return F.abs(signed_area(flat)) / 10000


def utm_point(p: Column, meridian: Column) -> Column:
    """Transverse Mercator of the zone with this central meridian, by the series in the third flattening."""
    n = 1 / (2 * 298.257223563 - 1)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    sin_lat = F.sin(F.radians(p["y"]))
    turned = F.sinh(F.atanh(sin_lat) - e * F.atanh(e * sin_lat))
    dl = F.radians(p["x"] - meridian)

    def placed(angles: Column) -> Column:
        xi, eta = angles["xi"], angles["eta"]
        east = eta + sum((F.cos(2 * j * xi) * F.sinh(2 * j * eta) * a for j, a in enumerate(alpha, 1)), F.lit(0.0))
        north = xi + sum((F.sin(2 * j * xi) * F.cosh(2 * j * eta) * a for j, a in enumerate(alpha, 1)), F.lit(0.0))
        return F.struct((east * scale).alias("x"), (north * scale).alias("y"))

    angles = lambda t: F.struct(F.atan2(t, F.cos(dl)).alias("xi"), F.atanh(F.sin(dl) / F.sqrt(1 + t * t)).alias("eta"))
    return _once(_once(turned, angles), placed)


def utm_hectares(ring: Column) -> Column:
    meridian = F.floor((F.get(ring, F.lit(0))["x"] + 180) / 6) * 6 - 177
    return F.abs(signed_area(F.transform(ring, lambda p: utm_point(p, meridian)))) / 10000


def perimeter(ring: Column) -> Column:
    return _sum(_pairs(ring, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))))


def roundness(ring: Column) -> Column:
    """4 pi area / perimeter squared: 1 for a circle."""
    return 4 * pi * F.abs(signed_area(ring)) / (perimeter(ring) * perimeter(ring))


def centroid(ring: Column) -> Column:
    """Centre of mass; the ring is moved to its first point so that no digits are lost."""
    o = F.get(ring, F.lit(0))
    moved = F.transform(ring, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))
    a = signed_area(moved) * 6
    cx = _sum(_pairs(moved, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    cy = _sum(_pairs(moved, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    return F.struct((o["x"] + cx / a).alias("x"), (o["y"] + cy / a).alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of sides lie right of the point."""
    crossings = F.aggregate(
        _pairs(ring, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), 1).otherwise(0)),
        F.lit(0), lambda a, v: a + v,
    )
    return crossings % 2 == 1


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment, in degrees."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    ex, ey = x - ax - t * dx, y - ay - t * dy
    return F.sqrt(ex * ex + ey * ey)


def boundary_distance(ring: Column, x: Column, y: Column) -> Column:
    return F.array_min(_pairs(ring, lambda p, q: segment_distance(x, y, p["x"], p["y"], q["x"], q["y"])))


def haversine(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2.0) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2.0)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def sector(x: Column, y: Column, cx: Column, cy: Column, k: int) -> Column:
    """Sector of a point about a centre, counter-clockwise; sector 0 lies around east."""
    width = 2 * pi / k
    turn = F.atan2(y - cy, x - cx) + pi / k
    turn = turn - 2 * pi * F.floor(turn / (2 * pi))
    return F.least(F.floor(turn / width).cast("int"), F.lit(k - 1))


def axis_angle(dx: Column, dy: Column) -> Column:
    """Direction of a line without its sense: degrees from 0 up to 180."""
    d = F.degrees(F.atan2(dy, dx))
    return d - 180 * F.floor(d / 180)


def circle(x: Column, y: Column, metres: float, corners: int = 64) -> Column:
    """A closed ring around a point."""
    r = F.greatest(F.lit(metres / 111320), F.lit(metres) / (111320 * F.cos(F.radians(y))))
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: F.struct((x + r * F.cos(2 * pi * (k % corners) / corners)).alias("x"), (y + r * F.sin(2 * pi * (k % corners) / corners)).alias("y")))


def box_hectares(north: Column, south: Column, east: Column, west: Column) -> Column:
    """Area of a box: its width at the middle latitude by its height."""
    mid = (north + south) / 2
    return haversine(mid, west, mid, east) * haversine(south, west, north, west) / 10000


def approximate_hectares(ring: Column) -> Column:
    """Shoelace area with a fixed length of a degree, at the middle latitude of the ring's box."""
    low, high = F.array_min(F.transform(ring, lambda p: p["y"])), F.array_max(F.transform(ring, lambda p: p["y"]))
    return F.abs(signed_area(ring)) * 111320 * 111320 * F.cos(F.radians((low + high) / 2)) / 10000
