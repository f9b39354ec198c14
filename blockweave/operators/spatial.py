"""Spatial joins by grid buckets: points in cells, edges of cells, nearest nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweave.functions import rings
from blockweave.functions.lineage import cut

#: Side of a bucket in degrees.
BUCKET = 1 / 256


def _bucket(v, size: float):
    return F.floor(v / F.lit(size)).cast("long")


def bucketed(shapes: DataFrame, ring: str = "ring", size: float = BUCKET, margin: float = 0.0) -> DataFrame:
    """A row of the shape, with its box (x0, x1, y0, y1), for each bucket (bx, by) that the box meets."""
    side = lambda axis, f, m: f(F.transform(ring, lambda p: p[axis])) + F.lit(m)
    s = shapes.withColumns({"x0": side("x", F.array_min, -margin), "x1": side("x", F.array_max, margin), "y0": side("y", F.array_min, -margin), "y1": side("y", F.array_max, margin)})
    s = s.withColumn("bx", F.explode(F.sequence(_bucket(F.col("x0"), size), _bucket(F.col("x1"), size))))
    return s.withColumn("by", F.explode(F.sequence(_bucket(F.col("y0"), size), _bucket(F.col("y1"), size))))


def points_in_boxes(points: DataFrame, cells: DataFrame, size: float = BUCKET) -> DataFrame:
    """Points (any columns with x, y) with cell_id and ring of each cell in whose box they lie."""
    p = points.withColumns({"bx": _bucket(F.col("x"), size), "by": _bucket(F.col("y"), size)})
    in_box = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    near = p.join(bucketed(cells.select("cell_id", "ring"), size=size), ["bx", "by"]).where(in_box)
    return near.drop("bx", "by", "x0", "x1", "y0", "y1")


def points_in_cells(points: DataFrame, cells: DataFrame, size: float = BUCKET) -> DataFrame:
    """Points (any columns with x, y) with the cell_id that contains them; the smallest of several."""
    hits = points_in_boxes(points, cells, size).where(rings.contains(F.col("ring"), F.col("x"), F.col("y")))
    keys = [c for c in points.columns]
    return hits.groupBy(*keys).agg(F.min("cell_id").alias("cell_id"))


def cell_edges(edges: DataFrame, cells: DataFrame, size: float = BUCKET, touch: float = 1e-9) -> DataFrame:
    """(cell_id, u, v, key, role): boundary if both ends lie on the ring, interior if its middle is inside.

    Edges come with ux, uy, vx, vy.
    """
    e = edges.withColumns({"mx": (F.col("ux") + F.col("vx")) / 2, "my": (F.col("uy") + F.col("vy")) / 2})
    e = e.withColumns({"bx": _bucket(F.col("mx"), size), "by": _bucket(F.col("my"), size)})
    in_box = F.col("mx").between(F.col("x0"), F.col("x1")) & F.col("my").between(F.col("y0"), F.col("y1"))
    # Plain comparisons with the box leave one or two cells of an edge; rings are looked at after that, a batch of edges at a time.
    near = e.join(bucketed(cells.select("cell_id", "ring"), size=size, margin=touch), ["bx", "by"]).where(in_box)
    on_ring = lambda x, y: rings.boundary_distance(F.col("ring"), F.col(x), F.col(y)) <= touch
    role = F.when(on_ring("mx", "my") & on_ring("ux", "uy") & on_ring("vx", "vy"), "boundary").when(rings.contains(F.col("ring"), F.col("mx"), F.col("my")), "interior")
    return cut(near.select("cell_id", "u", "v", "key", role.alias("role"))).where("role is not null")


def cell_entries(links: DataFrame) -> DataFrame:
    """(cell_id, node_id) of nodes that an interior and a boundary edge of the cell share."""
    ends = links.select("cell_id", "role", F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("cell_id", "node_id").agg(F.count(F.when(F.col("role") == "boundary", 1)).alias("b"), F.count(F.when(F.col("role") == "interior", 1)).alias("i")).where("b > 0 and i > 0").select("cell_id", "node_id")


def adjacent_cells(cells: DataFrame) -> DataFrame:
    """(a, b), a < b, of cells that share a side."""
    n = F.size("ring")
    sides = cells.select("cell_id", F.explode(F.zip_with(F.slice("ring", F.lit(1), n - 1), F.slice("ring", F.lit(2), n - 1), lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")))).alias("s"))
    a, b = sides.alias("a"), sides.alias("b")
    return a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.cell_id") < F.col("b.cell_id"))).select(F.col("a.cell_id").alias("a"), F.col("b.cell_id").alias("b")).distinct()


def nearest(points: DataFrame, nodes: DataFrame, key: str, size: float = BUCKET) -> DataFrame:
    """Each point's nearest node in degrees, the smallest id of equals: key, node_id, d2.

    Buckets of growing size hold the boxes of their nodes.  A point looks at the nine
    buckets around it, in larger and larger buckets until one of them is occupied; from
    one size above that, where the nearest node can't lie outside, it goes down again and
    keeps the buckets that may still hold it.  So a far point costs a few buckets a size,
    and nodes are never sent whole to a task.  Points without coordinates have no row; if
    there are no nodes, the others have a null node.
    """
    at = lambda v, k: _bucket(v, size * 4.0**k)
    n = nodes.where("x is not null and y is not null").select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), at(F.col("x"), 0).alias("bx"), at(F.col("y"), 0).alias("by"))
    left = cut(points.where("x is not null and y is not null").select(key, "x", "y"))
    corners = lambda x0, x1, y0, y1: [F.min(x0).alias("x0"), F.max(x1).alias("x1"), F.min(y0).alias("y0"), F.max(y1).alias("y1")]
    boxes = [cut(n.groupBy("bx", "by").agg(*corners("nx", "nx", "ny", "ny")))]
    if not boxes[0].limit(1).count():
        return left.select(key, F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"), F.lit(None).cast("double").alias("d2"))

    def grow() -> None:
        up = boxes[-1].withColumns({"bx": F.floor(F.col("bx") / 4), "by": F.floor(F.col("by") / 4)})
        boxes.append(cut(up.groupBy("bx", "by").agg(*corners("x0", "x1", "y0", "y1"))))

    def around(p: DataFrame, k: int) -> DataFrame:
        steps = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
        p = p.withColumn("bx", F.explode(F.transform(steps, lambda d: at(F.col("x"), k) + d))).withColumn("by", F.explode(F.transform(steps, lambda d: at(F.col("y"), k) + d)))
        return p.join(boxes[k], ["bx", "by"])

    started: list[DataFrame] = []
    while left.limit(1).count():
        hit = cut(around(left, len(started)).select(key).distinct())
        started.append(cut(left.join(hit, key, "left_semi")))
        left = cut(left.join(hit, key, "left_anti"))
        grow()
    active = None
    for k in range(len(started), -1, -1):
        near = around(started[k - 1], k) if k else None
        if active is not None:
            up = active.withColumnsRenamed({"bx": "px", "by": "py"})
            inside = boxes[k].withColumns({"px": F.floor(F.col("bx") / 4), "py": F.floor(F.col("by") / 4)})
            inner = up.join(inside, ["px", "py"]).drop("px", "py")
            near = inner if near is None else near.unionByName(inner)
        if near is None:
            break
        gap = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))
        span = lambda v, a, b: F.greatest(F.abs(F.col(a) - F.col(v)), F.abs(F.col(v) - F.col(b)))
        square = lambda f: f("x", "x0", "x1") * f("x", "x0", "x1") + f("y", "y0", "y1") * f("y", "y0", "y1")
        near = near.withColumns({"least": square(gap), "most": square(span)})
        bound = F.min("most").over(W.partitionBy(key))
        active = cut(near.withColumn("bound", bound).where("least <= bound").select(key, "x", "y", "bx", "by"))
    if active is None:
        return left.select(key, F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"), F.lit(None).cast("double").alias("d2"))
    d2 = (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))
    best = active.join(n, ["bx", "by"]).withColumn("d2", d2).groupBy(key).agg(F.min(F.struct("d2", "node_id")).alias("m"))
    return best.select(key, F.col("m.node_id").alias("node_id"), F.col("m.d2").alias("d2"))
