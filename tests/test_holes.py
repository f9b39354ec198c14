"""Faces with islands."""

import pytest

from blockweave.operators import partition, polygonize
from blockweave.plans.all import QUERIES


def square(x, y, n, start):
    """Corners and sides of a square."""
    nodes = [(start + k, float(x + dx * n), float(y + dy * n)) for k, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    return nodes, [(start, start + 1), (start + 1, start + 2), (start + 2, start + 3), (start, start + 3)]


def made(*squares, bridges=()):
    nodes, links = [], []
    for k, (x, y, n) in enumerate(squares):
        a, b = square(x, y, n, 10 * k)
        nodes += a
        links += b
    return nodes, links + list(bridges)


def shoelace(ring):
    return sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:], strict=False))


CASES = {
    # squares (x, y, side) and bridges; twice the areas and the numbers of holes of the faces.
    "island": (made((0, 0, 10), (2, 2, 3)), [(18.0, 0), (182.0, 1)]),
    "island on a bridge": (made((0, 0, 10), (2, 2, 3), bridges=[(0, 10)]), [(18.0, 0), (182.0, 1)]),
    "two islands, one with a pond": (made((0, 0, 20), (2, 2, 6), (4, 4, 1), (12, 12, 5)), [(2.0, 0), (50.0, 0), (70.0, 1), (678.0, 2)]),
    "apart": (made((0, 0, 2), (5, 5, 1)), [(2.0, 0), (8.0, 0)]),
    "island at the same height as a corner": (made((0, 0, 10), (4, 0.5, 9)), [(38.0, 1), (162.0, 0)]),
}


@pytest.mark.parametrize("name", CASES)
def test_islands_are_holes_of_the_smallest_face_around(spark, name):
    (nodes, links), want = CASES[name]
    scale = 1 / 256
    n = spark.createDataFrame([(k, x * scale, y * scale) for k, x, y in nodes], "node_id long, x double, y double")
    rows = polygonize.face_polygons(spark.createDataFrame([(min(p), max(p)) for p in links], "lo long, hi long"), n).collect()
    assert sorted((r.area2 / scale**2, len(r.holes)) for r in rows) == want
    for r in rows:
        assert shoelace(r.ring) > 0 and all(shoelace(h) < 0 for h in r.holes)
        assert shoelace(r.ring) + sum(map(shoelace, r.holes)) == pytest.approx(r.area2)


def test_town_faces_add_up(spark):
    """Faces less their islands, and islands, fill what the outermost rings enclose: each piece of a street bounds two faces, or one and the outside."""
    rows = QUERIES["town_faces"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.islands for r in rows) >= 1 and all(r.area2 > 0 for r in rows)


def test_union_around_a_gap(spark):
    """Eight cells around a ninth: the union's area leaves the gap out."""
    u = 1 / 512
    ring = lambda i, j: [{"x": 19 + (i + a) * u, "y": 47 + (j + b) * u} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    cells = [(3 * i + j, ring(i, j)) for i in range(3) for j in range(3)]
    s = spark.createDataFrame(cells, "cell_id long, ring array<struct<x:double,y:double>>")
    labels = spark.createDataFrame([(k, k if k == 4 else 0) for k, _ in cells], "cell_id long, merged_id long")
    got = {r.cell_id: r.area_ha for r in partition.merged(s, partition.sides(s), labels).collect()}
    assert got[0] == pytest.approx(8 * got[4], rel=1e-3)
