"""Rings that aren't simple: why, and what is left of them.

A ring is noded with itself: its sides are split where they cross, touch or share a
stretch, in the grid buckets of their boxes and within their own ring only.  The faces of
all rings' pieces are found together, by the same rounds of joins as those of streets, as
pieces of different rings share no node.  A face belongs to the polygon if the ring, turned
counter-clockwise as a whole, winds around it: of a bow tie the larger lobe stays, a spike
has no face, and what is wound twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions.lineage import cut
from blockweave.operators import noding, polygonize
from blockweave.operators.spatial import BUCKET

#: Sides of 1e-10 degrees and less are none; a point this part of a side's length beside it lies in the face to its left.
NEAR, ASIDE = 1e-10, 1e-4
GRID = 1e10


def _sides(shapes: DataFrame) -> DataFrame:
    """cell_id, k, seg_id and both ends of the sides that have a length."""
    n = F.size("ring")
    pair = F.zip_with(F.slice("ring", F.lit(1), n - 1), F.slice("ring", F.lit(2), n - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    s = shapes.where(n > 1).select("cell_id", F.posexplode(pair).alias("k", "s")).select("cell_id", "k", F.xxhash64("cell_id", "k").alias("seg_id"), "s.*")
    return s.where((F.abs(F.col("x2") - F.col("x1")) > NEAR) | (F.abs(F.col("y2") - F.col("y1")) > NEAR))


def _winding(ring: Column, x: Column, y: Column) -> Column:
    """How often a ring goes around a point, counter-clockwise."""
    left = lambda p, q: (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
    step = lambda p, q: F.when((p["y"] <= y) & (q["y"] > y) & (left(p, q) > 0), 1).when((p["y"] > y) & (q["y"] <= y) & (left(p, q) < 0), -1).otherwise(0)
    return F.aggregate(G._pairs(ring, step), F.lit(0), lambda a, v: a + v)


def reasons(shapes: DataFrame, size: float = BUCKET) -> DataFrame:
    """(cell_id, ring) -> cell_id and the first reason for which the ring isn't a simple polygon, null if there is none.

    empty: null or less than four points; open: its ends differ; repeated: a point twice in
    a row; spike: it turns back on itself; crossing: sides meet elsewhere than at common ends.
    """
    ring, n = F.col("ring"), F.size("ring")
    step = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct((q["x"] - p["x"]).alias("x"), (q["y"] - p["y"]).alias("y")))
    repeated = F.exists(step, lambda d: (F.abs(d["x"]) <= NEAR) & (F.abs(d["y"]) <= NEAR))
    # Each side with the next one, the last with the first.
    turned = F.zip_with(step, F.concat(F.slice(step, F.lit(2), n - 2), F.slice(step, F.lit(1), F.lit(1))), lambda a, b: (F.abs(a["x"] * b["y"] - a["y"] * b["x"]) <= 1e-12 * F.sqrt((a["x"] * a["x"] + a["y"] * a["y"]) * (b["x"] * b["x"] + b["y"] * b["y"]))) & (a["x"] * b["x"] + a["y"] * b["y"] < 0))
    short = ring.isNull() | (n < 4)
    first, last = F.get(ring, F.lit(0)), F.get(ring, n - 1)
    plain = F.when(short, "empty").when(first != last, "open").when(repeated, "repeated").when(F.exists(turned, lambda t: t), "spike")
    sides = cut(_sides(shapes.where(~short)))
    met = noding.crossings(sides, size, "cell_id").join(sides.select("seg_id", "cell_id"), "seg_id").select("cell_id").distinct()
    # Two corners in one place split no side; they are told by their place.
    spot = sides.groupBy("cell_id", F.round(F.col("x1") * GRID).alias("px"), F.round(F.col("y1") * GRID).alias("py")).agg(F.count("*").alias("c")).where("c > 1").select("cell_id")
    met = met.union(spot).distinct().withColumn("met", F.lit("crossing"))
    return shapes.select("cell_id", plain.alias("plain")).join(met, "cell_id", "left").select("cell_id", F.coalesce("plain", "met").alias("reason"))


def repaired(shapes: DataFrame, size: float = BUCKET) -> DataFrame:
    """(cell_id, ring) -> cell_id, part, ring and area2 (twice the area) of the parts that rings enclose; rings without any have no row."""
    turned = F.when(G.signed_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring"))
    shapes = cut(shapes.where(F.size("ring") > 3).select("cell_id", turned.alias("ring")))
    sides = cut(_sides(shapes))
    pieces = noding.split_at_crossings(sides, size, "cell_id").join(sides.select("seg_id", "cell_id"), "seg_id")
    at = lambda x, y: F.xxhash64("cell_id", F.round(F.col(x) * GRID).cast("long"), F.round(F.col(y) * GRID).cast("long"))
    pieces = cut(pieces.select("cell_id", at("x1", "y1").alias("a"), at("x2", "y2").alias("b"), "x1", "y1", "x2", "y2").where("a <> b"))
    ends = pieces.select("cell_id", F.col("a").alias("node_id"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(pieces.select("cell_id", "b", "x2", "y2"))
    points = cut(ends.groupBy("cell_id", "node_id").agg(F.min("x").alias("x"), F.min("y").alias("y")))
    links = pieces.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    labelled = polygonize._labelled(links, points.select("node_id", "x", "y"))
    labelled = labelled.withColumn("part", F.xxhash64("label.a", "label.b")).join(points.select(F.col("node_id").alias("a"), "cell_id"), "a")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    spot = F.struct((dx * dx + dy * dy).alias("n"), ((F.col("ax") + F.col("bx")) / 2 - dy * ASIDE).alias("x"), ((F.col("ay") + F.col("by")) / 2 + dx * ASIDE).alias("y"))
    faces = labelled.groupBy("cell_id", "part").agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("area2"), F.max(spot).alias("spot")).where("area2 > 0")
    kept = cut(faces.join(shapes, "cell_id").where(_winding(F.col("ring"), F.col("spot.x"), F.col("spot.y")) > 0).select("cell_id", "part", "area2"))
    outlines = polygonize.rings(labelled.drop("cell_id").join(kept.select("part"), "part", "left_semi"), "part")
    return kept.join(outlines, "part").select("cell_id", "part", "ring", "area2")
