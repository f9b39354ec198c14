"""Reasons and repair of rings that aren't simple, against a raster count."""

import random

import pytest

from blockweave.operators import validity

U = 1 / 4096
FORM = "cell_id long, ring array<struct<x:double,y:double>>"


def table(spark, rings):
    return spark.createDataFrame([(k, None if z is None else [{"x": 19 + x * U, "y": 47 + y * U} for x, y in z]) for k, z in rings.items()], FORM)


RINGS = {
    1: ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], None, 16), 2: ([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], None, 16), 3: ([(0, 0), (4, 0), (0, 4), (4, 4), (0, 0)], "crossing", 4),
    4: ([(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)], "repeated", 16), 5: ([(0, 0), (8, 0), (4, 0), (4, 4), (0, 4), (0, 0)], "spike", 16), 6: ([(0, 0), (4, 4), (0, 0), (4, 4), (0, 0)], "spike", 0),
    7: ([(0, 0), (4, 0), (4, 4), (0, 4)], "open", None), 8: ([(0, 0), (1, 1), (0, 0)], "empty", None), 9: (None, "empty", None),
    10: ([(0, 0), (8, 0), (8, 8), (2, 8), (2, 2), (6, 2), (6, 6), (0, 6), (0, 0)], "crossing", None), 11: ([(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)], "crossing", 8),
}


def test_reasons(spark):
    got = {r.cell_id: r.reason for r in validity.reasons(table(spark, {k: v[0] for k, v in RINGS.items()})).collect()}
    assert got == {k: v[1] for k, v in RINGS.items()}


def winding(ring, x, y):
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        left = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        n += (ay <= y < by and left > 0) - (by <= y < ay and left < 0)
    return n


def raster(ring, fine=32):
    """Area of the places around which the ring, turned counter-clockwise, winds."""
    signed = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
    ring = ring[::-1] if signed < 0 else ring
    top = max(max(p) for p in ring)
    return sum(winding(ring, (i + 0.5) / fine, (j + 0.5) / fine) > 0 for i in range(top * fine) for j in range(top * fine)) / fine**2


def test_areas(spark):
    r = random.Random(3)
    rings = {k: v[0] for k, v in RINGS.items() if v[2] is not None}
    for k in range(100, 112):
        z = [(r.randrange(0, 7), r.randrange(0, 7)) for _ in range(r.randrange(4, 8))]
        z = [p for j, p in enumerate(z) if not j or p != z[j - 1]]
        rings[k] = [*z, z[0]]
    areas = {}
    for x in validity.repaired(table(spark, rings)).collect():
        assert x.ring[0] == x.ring[-1]
        areas[x.cell_id] = areas.get(x.cell_id, 0) + x.area2 / 2 / U**2
    for k, z in rings.items():
        known = RINGS[k][2] if k in RINGS else None
        signed = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(z, z[1:], strict=False)))
        if known is not None:
            assert areas.get(k, 0) == pytest.approx(known, abs=1e-3), k
        elif signed:  # without a sense of its own a ring may be turned either way
            assert areas.get(k, 0) == pytest.approx(raster(z), abs=0.25), k
