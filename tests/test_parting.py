"""Polygons parted by bent lines."""

import numpy as np
import pytest

from blockweave.functions import geometry as G
from blockweave.operators import parting
from blockweave.plans.all import QUERIES
from blockweave.sources import network as S

SF = "/root/testdata/sf0.001"
SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
U = [(0, 0), (6, 0), (6, 4), (4, 4), (4, 1), (2, 1), (2, 4), (0, 4), (0, 0)]
COMB = [(0, 0), (9, 0), (9, 4), (8, 4), (8, 1), (6, 1), (6, 4), (5, 4), (5, 1), (3, 1), (3, 4), (0, 4), (0, 0)]


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False)) / 2


CASES = {
    # ring, line, the parts' areas; a line of two points is carried on by the ring's width.
    "beside the middle": (SQUARE, [(1, 1), (1, 2)], [4, 12]),
    "middle": (SQUARE, [(2, 1), (2, 3)], [8, 8]),
    "through corners": (SQUARE, [(1.5, 1.5), (2.5, 2.5)], [8, 8]),
    "both arms of a U": (U, [(0.5, 3), (1, 3)], [2, 2, 14]),
    "one of a U's arms": (U, [(1, 3.5), (1, 3)], [4, 14]),
    "along the U's inner side": (U, [(0.5, 1), (1, 1)], [6, 6, 6]),
    "three teeth": (COMB, [(0.5, 3), (1, 3)], [1, 1, 3, 19]),
    "bent": (SQUARE, [(1, 2), (2, 3), (3, 2)], [7, 9]),
    "bent outside and back": (SQUARE, [(1, 1), (1, 5), (3, 5), (3, 1)], [3, 3, 10]),
    "beside": (SQUARE, [(9, 1), (9, 2)], None),
    "along a side": (SQUARE, [(1, 0), (2, 0)], None),
    "without length": (SQUARE, [(1, 1), (1, 1)], None),
    "a loop inside another part": (SQUARE, [(1, 2), (3, 2), (3, 3), (2, 3), (2, 1), (3, 1)], None),
    "far too short for a tall ring": ([(0, 0), (1, 0), (1, 50), (0, 50), (0, 0)], [(0.5, 20), (0.5, 21)], None),
}


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("name", CASES)
def test_parts(name, turned):
    ring, line, want = (np.array(c, float) if isinstance(c, list) and isinstance(c[0], tuple) else c for c in CASES[name])
    ring = ring[::-1] if turned else ring
    line = parting.lengthened(line, np.ptp(ring[:, 0]))
    got = line is not None and parting.parts(ring, line)
    assert sorted(map(area, got)) == pytest.approx(want) if want else not got


def crossings(ring, line):
    """Proper crossings, one pair after the other."""
    side = lambda a, b, p: np.sign((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))
    pairs = [(a, b, c, d) for a, b in zip(line, line[1:], strict=False) for c, d in zip(ring, ring[1:], strict=False)]
    return sum(side(a, b, c) != side(a, b, d) and side(c, d, a) != side(c, d, b) for a, b, c, d in pairs)


@pytest.mark.parametrize("seed", range(60))
def test_random_stars_by_rising_lines(seed):
    """A line that meets no part of itself makes one part more for every two crossings, and areas add up."""
    r = np.random.default_rng(seed)
    n = r.integers(5, 40)
    turn = np.sort(r.random(n)) * 2 * np.pi
    star = np.c_[np.cos(turn), np.sin(turn)] * r.uniform(0.2, 1, (n, 1))
    ring = np.vstack([star, star[:1]])
    m = r.integers(2, 12)
    line = np.c_[np.linspace(-2, 2, m), r.uniform(-0.6, 0.6, m)]
    got = parting.parts(ring, line)
    k = crossings(ring, line)
    assert len(got or [1]) == 1 + k // 2
    if got:
        assert all(area(p) > 0 for p in got) and sum(map(area, got)) == pytest.approx(abs(area(ring)))
        assert all(len({tuple(c) for c in p.tolist()}) == len(p) - 1 for p in got)


def test_rows_without_a_shape_part_nothing(spark):
    point = "array<struct<x:double,y:double>>"
    ring = lambda ps: ps and [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [(1, ring(U), ring([(0.5, 3), (1, 3)])), (2, None, ring([(0, 0), (1, 1)])), (3, ring(U), None), (4, [], []), (5, ring(U), ring([(1, 1)]))]
    got = parting.parted(spark.createDataFrame(rows, f"cell_id long, ring {point}, geom {point}"), ["cell_id"]).collect()
    assert [(r.cell_id, r.part) for r in sorted(got)] == [(1, 0), (1, 1), (1, 2)]
    assert parting.parted(spark.createDataFrame([], f"cell_id long, ring {point}, geom {point}"), ["cell_id"]).count() == 0


def test_parts_of_cells_add_up(spark):
    whole = {r[0]: r[1] for r in S.cells(spark, SF).select("cell_id", G.signed_area(G.F.col("ring"))).collect()}
    rows = QUERIES["town_cells_parted"](spark, SF).collect()
    assert rows and all(r.area2 == pytest.approx(2 * abs(whole[r.cell_id]), abs=1e-11) and r.parts > 1 and 0 < r.least2 < r.area2 for r in rows)
