"""Points against closed rings, a batch of rows at a time: the same arithmetic as the expressions in ``geometry``, over Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of a point and a side that are worked on at once.
PAIRS = 500_000


class _Rings:
    """Rings of a batch as flat arrays."""

    def __init__(self, rings: pa.Array):
        n = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rings.flatten()
        self.x, self.y = (flat.field(c).to_numpy(zero_copy_only=False) for c in "xy")
        self.start, self.count = np.cumsum(n) - n, np.maximum(n - 1, 0)

    def pairs(self, of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of the points, whose rings are ``of``: first and end of the run, and the place in it and first corner of each pair with a side."""
        count = self.count[of]
        done = np.cumsum(count)
        a = 0
        while a < len(of):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
            row = np.repeat(np.arange(b - a), count[a:b])
            within = np.arange(len(row)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            yield a, b, row, self.start[of[a:b]][row] + within
            a = b


def _inside(r: _Rings, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ray casting: an odd number of sides lie right of the point."""
    out = np.zeros(len(of), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b, row, p in r.pairs(of):
            px, py, qx, qy, u, v = r.x[p], r.y[p], r.x[p + 1], r.y[p + 1], x[a:b][row], y[a:b][row]
            right = ((py > v) != (qy > v)) & (u < (qx - px) * (v - py) / (qy - py) + px)
            out[a:b] = np.bincount(row[right], minlength=b - a) % 2 == 1
    return out


def _distance(r: _Rings, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance from the nearest side, in degrees; nan for rings without a side."""
    out = np.full(len(of), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b, row, p in r.pairs(of):
            ax, ay, u, v = r.x[p], r.y[p], x[a:b][row], y[a:b][row]
            dx, dy = r.x[p + 1] - ax, r.y[p + 1] - ay
            square = dx * dx + dy * dy
            t = np.where(square == 0, 0.0, np.clip(((u - ax) * dx + (v - ay) * dy) / square, 0.0, 1.0))
            ex, ey = u - ax - t * dx, v - ay - t * dy
            first = np.flatnonzero(np.diff(row, prepend=-1))
            if len(first):
                out[a + row[first]] = np.minimum.reduceat(np.sqrt(ex * ex + ey * ey), first)
    return out


def _double(v: pa.Array) -> np.ndarray:
    return v.to_numpy(zero_copy_only=False).astype(float)


@F.arrow_udf(T.BooleanType())
def contains(ring: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether the ring holds the point; null without a ring."""
    return pa.array(_inside(_Rings(ring), np.arange(len(ring)), _double(x), _double(y)), mask=ring.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def boundary_distance(ring: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Distance of the point from the ring, in degrees; null without a side or a point."""
    far = _distance(_Rings(ring), np.arange(len(ring)), _double(x), _double(y))
    return pa.array(far, mask=np.isnan(far))


def places(touch: float):
    """A function of a ring and an array of points: 0 for a point nearer to the ring than ``touch``, 1 for one inside, 2 for one outside."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def placed(ring: pa.Array, spots: pa.Array) -> pa.Array:
        n = spots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, r = spots.flatten(), _Rings(ring)
        of, (x, y) = np.repeat(np.arange(len(ring)), n), (_double(flat.field(c)) for c in "xy")
        place = np.where(_distance(r, of, x, y) <= touch, 0, np.where(_inside(r, of, x, y), 1, 2))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(place, pa.int32()))

    return placed


def meetings(touch: float):
    """A function of the ends of a piece and of a side (x1, y1, x2, y2 of each): where along the piece (0 to 1) the side meets it.

    One place, both ends of a stretch that they share, or null.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def met(px1: pa.Array, py1: pa.Array, px2: pa.Array, py2: pa.Array, qx1: pa.Array, qy1: pa.Array, qx2: pa.Array, qy2: pa.Array) -> pa.Array:
        x1, y1, x2, y2, u1, v1, u2, v2 = (_double(c) for c in (px1, py1, px2, py2, qx1, qy1, qx2, qy2))
        dx, dy, sx, sy, ex, ey = x2 - x1, y2 - y1, u2 - u1, v2 - v1, u1 - x1, v1 - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            long, side = np.sqrt(dx * dx + dy * dy), np.sqrt(sx * sx + sy * sy)
            turn = dx * sy - dy * sx
            # Sides at an angle of less than a part in 1e12 count as parallel.
            apart = np.abs(turn) > 1e-12 * long * side
            t, u = (ex * sy - ey * sx) / turn, (ex * dy - ey * dx) / turn
            slack, slack_side = touch / long, touch / side
            hit = apart & (t >= -slack) & (t <= 1 + slack) & (u >= -slack_side) & (u <= 1 + slack_side)
            a, b = (ex * dx + ey * dy) / (long * long), ((ex + sx) * dx + (ey + sy) * dy) / (long * long)
            low, high = np.minimum(a, b), np.maximum(a, b)
            beside = np.abs(dx * ey - dy * ex) / long <= touch
            shared = ~apart & (long > 0) & beside & (high >= -slack) & (low <= 1 + slack)
        clip = lambda v: np.where(v <= 0, 0.0, np.where(v >= 1, 1.0, v))
        n = np.where(hit, 1, np.where(shared, 2, 0))
        pair = np.stack([clip(np.where(hit, t, low)), clip(high)], axis=1)
        values = pair[np.arange(2) < n[:, None]]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values, pa.float64()), mask=pa.array(n == 0))

    return met
