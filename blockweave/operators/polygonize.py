"""Faces of a planar network, by joins over half-edges."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockweave.functions import rings as ring_functions
from blockweave.functions.lineage import cut
from blockweave.operators.spatial import points_in_boxes

RING = "ring array<struct<x:double,y:double>>"
HOLES = "holes array<array<struct<x:double,y:double>>>"


def _without_dangles(links: DataFrame) -> DataFrame:
    """Links (lo, hi) without those that end at a node of degree 1, again and again."""
    links = cut(links.select("lo", "hi").distinct())
    while True:
        degree = links.select(F.explode(F.array("lo", "hi")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
        ends = cut(degree.where("d = 1").select("node"))
        if not ends.limit(1).count():
            return links
        for c in ("lo", "hi"):
            links = links.join(ends.withColumnRenamed("node", c), c, "left_anti")
        links = cut(links.select("lo", "hi"))


def _labelled(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Half-edges (a, b, ax, ay, bx, by) with the label of their face, those of bridges left out.

    Each half-edge is followed by the one that precedes its twin counter-clockwise at its
    end.  Cycles of that order get the smallest half-edge as label by pointer jumping.
    """
    links = _without_dangles(links)
    p = nodes.select("node_id", "x", "y")
    half = links.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(links.select("hi", "lo"))
    half = half.join(p.toDF("a", "ax", "ay"), "a").join(p.toDF("b", "bx", "by"), "b")
    half = cut(half.withColumn("angle", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))))
    at = W.partitionBy("a").orderBy("angle", "b")
    whole = W.partitionBy("a").orderBy("angle", "b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = half.select("a", "b", F.coalesce(F.lag("b").over(at), F.last("b").over(whole)).alias("c"))
    # (x -> u) goes on to the half-edge before (u -> x) at u.
    name = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    # A row knows the smallest of the 2**k half-edges from its own on, and the one after them.  If that one's smallest is the
    # same half-edge, both runs hold it, so together they go all around, and the row is done; a row whose next one
    # is done and gone knows its whole cycle, too.  So long outer rings alone stay for the late rounds.
    step, done = cut(turn.select(name("b", "a").alias("e"), name("a", "c").alias("next")).withColumn("label", F.col("e"))), []
    while step.limit(1).count():
        far = step.select(F.col("e").alias("next"), F.col("next").alias("n2"), F.col("label").alias("l2"))
        whole_way = F.col("l2").isNull() | (F.col("label") == F.col("l2"))
        new = cut(step.join(far, "next", "left").select("e", F.col("n2").alias("next"), F.least("label", "l2").alias("label"), whole_way.alias("done")))
        done.append(new.where("done").select("e", "label"))
        step = new.where("not done").select("e", "next", "label")
    ends = reduce(DataFrame.union, done, step.select("e", "label"))
    labelled = ends.select(F.col("e.a").alias("a"), F.col("e.b").alias("b"), "label").join(half.drop("angle"), ["a", "b"])
    # A half-edge whose twin has the same face is a bridge.
    twins = labelled.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("label").alias("twin"))
    return cut(labelled.join(twins, ["a", "b"]).where("label <> twin").drop("twin"))


def _areas(labelled: DataFrame) -> DataFrame:
    area2 = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))
    return cut(labelled.groupBy("label").agg(F.count("*").alias("n_edges"), area2.alias("area2")))


def faces(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lo, hi) that meet at nodes only, and (node_id, x, y) -> face_id, n_edges, area2 (twice the signed area), nodes.

    Bounded faces have a positive area and their nodes; the outer ring of each component
    has a negative area and, as it may be as long as the network, no list.
    """
    labelled = _labelled(links, nodes)
    areas = _areas(labelled)
    around = labelled.join(areas.where("area2 > 0").select("label"), "label", "left_semi").groupBy("label").agg(F.sort_array(F.collect_set("a")).alias("nodes"))
    return areas.join(around, "label", "left").select(F.concat_ws("-", F.col("label.a").cast("string"), F.col("label.b").cast("string")).alias("face_id"), "n_edges", "area2", "nodes")


def loops(sides: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Closed walks along directed sides (a, b), each as its nodes with the first one again at the end."""
    ahead: dict[int, list[int]] = defaultdict(list)
    for a, b in sorted(sides, reverse=True):
        ahead[a].append(b)
    out = []
    for start in sorted(ahead):
        while ahead[start]:
            walk, seen = [start], {start: 0}
            while ahead[walk[-1]]:
                b = ahead[walk[-1]].pop()
                walk.append(b)
                if b in seen:
                    # A loop is closed; the walk goes on from where it began.
                    out.append(walk[seen[b] :])
                    for x in walk[seen[b] + 1 : -1]:
                        del seen[x]
                    del walk[seen[b] + 1 :]
                else:
                    seen[b] = len(walk) - 1
    return out


def ring_of(a: list[int], b: list[int], ax: list[float], ay: list[float]) -> list[dict[str, float]] | None:
    """The largest loop of directed sides (a, b, ax, ay) as points; the others of a face are what touches it at a node."""
    at = dict(zip(a, zip(ax, ay, strict=True), strict=True))
    size = lambda w: abs(sum(at[p][0] * at[q][1] - at[q][0] * at[p][1] for p, q in zip(w, w[1:], strict=False)))
    every = loops(zip(a, b, strict=True))
    return [{"x": at[p][0], "y": at[p][1]} for p in max(every, key=lambda w: (size(w), w))] if every else None


def polygon_of(a: list[int], b: list[int], ax: list[float], ay: list[float]) -> tuple[list | None, list]:
    """The outline and the holes of directed sides (a, b, ax, ay): the largest loop that runs counter-clockwise, and the loops that run the other way."""
    at = dict(zip(a, zip(ax, ay, strict=True), strict=True))
    every = loops(zip(a, b, strict=True))
    size = lambda w: sum(at[p][0] * at[q][1] - at[q][0] * at[p][1] for p, q in zip(w, w[1:], strict=False))
    points = lambda w: [{"x": at[p][0], "y": at[p][1]} for p in w]
    shell = max((w for w in every if size(w) > 0), key=lambda w: (size(w), w), default=None)
    return shell and points(shell), [points(w) for w in sorted(every) if size(w) < 0]


_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _shapes(sides: pa.Array) -> Iterator[tuple[list, list, list, list]]:
    """The columns a, b, ax and ay of each row's sides."""
    flat = sides.flatten()
    columns = [flat.field(c).to_pylist() for c in ("a", "b", "ax", "ay")]
    start = 0
    for n in sides.value_lengths().to_pylist():
        yield tuple(c[start : start + n] for c in columns)
        start += n


_RING = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"]))


@F.arrow_udf(_RING)
def _ring(sides: pa.Array) -> pa.Array:
    return pa.array([ring_of(*columns) for columns in _shapes(sides)], _POINTS)


@F.arrow_udf(T.StructType([T.StructField("ring", _RING), T.StructField("holes", T.ArrayType(_RING))]))
def _polygon(sides: pa.Array) -> pa.Array:
    made = [polygon_of(*columns) for columns in _shapes(sides)]
    return pa.array([{"ring": ring, "holes": holes} for ring, holes in made], pa.struct([("ring", _POINTS), ("holes", pa.list_(_POINTS))]))


def _gathered(sides: DataFrame, key: str) -> DataFrame:
    """A row for each key with its sides, which are bounded by the shape's outline, in order."""
    return sides.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", "b", "ax", "ay"))).alias("sides"))


def polygons(sides: DataFrame, key: str) -> DataFrame:
    """(key, ring, holes) of directed sides (key, a, b, ax, ay) with the inside to their left; ring is null where all run clockwise."""
    # Called nondeterministic, so that a filter on what it gives doesn't trace every outline a second time.
    made = _gathered(sides, key).select(key, _polygon.asNondeterministic()("sides").alias("p"))
    return made.select(key, "p.ring", "p.holes")


def face_polygons(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell_id, ring, holes, area2) of the bounded faces; area2 is twice the area of the outline less its holes.

    A hole is an island: of those that a bridge joins with the outline the face's own walk
    knows, the others are components of their own.  The outer ring of a component is a hole
    of the smallest face that holds its leftmost node; the face can't touch that node, as
    components share none, and no face of the component itself holds it.  Outer rings
    that no face holds, which may be as long as the network, are never gathered.
    """
    labelled = _labelled(links, nodes).withColumn("cell_id", F.xxhash64("label.a", "label.b"))
    areas = cut(labelled.groupBy("cell_id").agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("area2"), F.min(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))).alias("first")))
    inner = cut(polygons(labelled.join(areas.where("area2 > 0").select("cell_id"), "cell_id", "left_semi"), "cell_id").where("ring is not null"))
    outer = areas.where("area2 < 0").select(F.col("cell_id").alias("island"), F.col("area2").alias("less"), "first.x", "first.y")
    size = areas.select("cell_id", "area2")
    held = points_in_boxes(outer, inner.select("cell_id", "ring")).where(ring_functions.contains("ring", "x", "y") & (ring_functions.boundary_distance("ring", "x", "y") > 1e-12))
    held = held.select("island", "less", "cell_id").join(size, "cell_id").groupBy("island", "less").agg(F.min(F.struct("area2", "cell_id")).alias("m"))
    held = cut(held.select("island", "less", F.col("m.cell_id").alias("cell_id")))
    sides = labelled.withColumnRenamed("cell_id", "island").join(held.select("island"), "island", "left_semi")
    rings_of = polygons(sides, "island").select("island", F.explode("holes").alias("hole"))
    islands = held.join(rings_of, "island").groupBy("cell_id").agg(F.array_sort(F.collect_list("hole")).alias("more"))
    less = held.groupBy("cell_id").agg(F.sum("less").alias("less"))
    out = inner.join(size, "cell_id").join(islands, "cell_id", "left").join(less, "cell_id", "left")
    return out.select("cell_id", "ring", F.concat("holes", F.coalesce("more", F.array().cast(HOLES.split(" ", 1)[1]))).alias("holes"), (F.col("area2") + F.coalesce("less", F.lit(0.0))).alias("area2"))


def rings(sides: DataFrame, key: str) -> DataFrame:
    """(key, ring) of directed sides (key, a, b, ax, ay); the sides of one key are a group, bounded by the shape's outline."""
    return _gathered(sides, key).select(key, _ring.asNondeterministic()("sides").alias("ring")).where("ring is not null")


def face_rings(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell_id, ring) of the bounded faces."""
    labelled = _labelled(links, nodes)
    bounded = labelled.join(_areas(labelled).where("area2 > 0").select("label"), "label", "left_semi")
    return rings(bounded.withColumn("cell_id", F.xxhash64("label.a", "label.b")), "cell_id")
