"""Registered queries over the town: sources, simplification, and what slanted streets give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions.lineage import cut
from blockweave.operators import access, display, graphs, lines, network, outlines, parting, partition, polygonize, simplify, sizing, traffic, validity
from blockweave.plans import catalog as C
from blockweave.sources import network as S
from blockweave.sources import town

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def source(spark: SparkSession, d: str, kind: str = "drive") -> DataFrame:
    """Edges of a kind, of the largest component that they make."""
    edges = cut(S.of_kind(town.edges(spark, d), kind))
    labels = graphs.components(network.simple(edges, F.col("length")))
    return edges.join(network.largest_component(labels).select(F.col("node").alias("u")), "u", "left_semi")


def _simplified(spark: SparkSession, d: str) -> DataFrame:
    return simplify.simplified(source(spark, d), town.nodes(spark, d))


@query
def town_kinds(spark, d):
    """Edges for driving, cycling and walking, and all."""
    e = town.edges(spark, d)
    parts = [S.of_kind(e, k).agg(F.count("*").alias("n"), F.sum("length").alias("metres")).select(F.lit(k).alias("kind"), "n", "metres") for k in ("drive", "bike", "walk", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def town_source(spark, d):
    """The town's network for driving as it is drawn."""
    return source(spark, d).select("u", "v", "key", "length")


@query
def town_simplified(spark, d):
    """The town's network for driving between junctions."""
    e = _simplified(spark, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    turn = F.get("geom", F.lit(1))
    return e.select("u", "v", "key", "n_pieces", "length", text("osmid").alias("osmids"), text("highway").alias("highways"), "oneway", F.size("geom").alias("points"), F.round(turn["x"], 9).alias("x1"), F.round(turn["y"], 9).alias("y1"))


@query
def town_directions(spark, d):
    """Metres of the town's streets by direction, in bins of five degrees."""
    return sizing.histogram(network.with_points(town.edges(spark, d), town.nodes(spark, d)))


@query
def town_size_recommendation(spark, d):
    n = town.nodes(spark, d)
    return sizing.recommend(sizing.grid(network.with_points(town.edges(spark, d), n), n.count()), 9000.0, 47.5)


@query
def town_streets_in_cells(spark, d):
    """How the town's bent streets lie to the grid's cells: those that meet the outline, lie within, or cross it, and the role that follows."""
    r = lines.relations(town.lines(spark, d), S.cells(spark, d), ["street_id"])
    role = F.when(F.col("meets"), "perimeter").when(F.col("holds"), "interior")
    return r.select("street_id", "cell_id", "meets", (F.col("inside") & ~F.col("outside")).alias("within"), (F.col("inside") & F.col("outside")).alias("crosses"), role.alias("role"))


@query
def town_cells_parted(spark, d):
    """The parts of the grid's cells by each of the town's bent streets that runs in them: how many, and twice the area of all and of the smallest."""
    r = lines.relations(town.lines(spark, d), S.cells(spark, d), ["street_id"]).where("inside").select("street_id", "cell_id")
    pairs = r.join(town.lines(spark, d), "street_id").join(S.cells(spark, d), "cell_id")
    made = parting.parted(pairs, ["cell_id", "street_id"]).withColumn("area2", 2 * G.signed_area(F.col("ring")))
    return made.groupBy("cell_id", "street_id").agg(F.count("*").alias("parts"), F.round(F.sum("area2"), 12).alias("area2"), F.round(F.min("area2"), 12).alias("least2"))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    at = network.with_points(town.edges(spark, d), town.nodes(spark, d)).where("u < v")
    segments = cut(at.select(F.xxhash64("u", "v").alias("seg_id"), F.col("ux").alias("x1"), F.col("uy").alias("y1"), F.col("vx").alias("x2"), F.col("vy").alias("y2")).distinct())
    pieces = cut(partition.noded(segments))
    ends = pieces.select(F.col("a").alias("node_id"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(pieces.select("b", "x2", "y2"))
    points = cut(ends.groupBy("node_id").agg(F.min("x").alias("x"), F.min("y").alias("y")))
    return polygonize.face_polygons(pieces.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), points)


@query
def town_faces(spark, d):
    """Faces between the town's streets, with the islands in them as holes."""
    f = _faces(spark, d)
    return f.select("cell_id", F.size("ring").alias("corners"), F.size("holes").alias("islands"), F.round("area2", 12).alias("area2"))


@query
def town_faces_thinned(spark, d):
    """The same faces with their outlines thinned by the usual tolerance, once for both neighbours."""
    f = outlines.thinned(cut(_faces(spark, d).select("cell_id", "ring", "holes")))
    area2 = F.aggregate("holes", 2 * G.signed_area(F.col("ring")), lambda a, h: a + 2 * G.signed_area(h))
    return f.select("cell_id", F.size("ring").alias("corners"), F.size("holes").alias("islands"), F.round(area2, 12).alias("area2"))


@query
def ring_reasons(spark, d):
    """Blocks by the reason for which their ring isn't a simple polygon."""
    return validity.reasons(town.rings(spark, d)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("rings"))


@query
def ring_repairs(spark, d):
    """What is left of each block's ring: its parts and twice their area."""
    parts = validity.repaired(town.rings(spark, d)).groupBy("cell_id").agg(F.count("*").alias("parts"), F.round(F.sum("area2"), 9).alias("area2"))
    return parts.select("cell_id", "parts", "area2")


@query
def town_arrows(spark, d):
    """Arrows along the town's bent streets, with their bearing."""
    a = town.lines(spark, d).select("street_id", F.posexplode(display.arrows(F.col("geom"))).alias("k", "a"))
    return a.select("street_id", "k", "a.place", F.round("a.x", 9).alias("x"), F.round("a.y", 9).alias("y"), F.round("a.angle", 6).alias("angle"))


@query
def street_colours(spark, d):
    """Colours of all streets in each mode of the map; the chosen block is the first cell."""
    first = S.cells(spark, d).agg(F.min("cell_id").alias("cell_id"))
    keys = ["u", "v", "key"]
    action = C.cell_interventions(spark, d).join(F.broadcast(first), "cell_id").select(*keys, "action")  # one row
    role = C._links(spark, d).join(F.broadcast(first), "cell_id").select(*keys, "role")
    # Of a block's interventions only those off its perimeter are listed here, so that its outline shows as such.
    action = action.where("action <> 'no_change' and action <> 'local_access'")
    plan = C._planned(spark, d).withColumn("kind", F.when(F.col("lo") % 14 == 0, "full_closure").otherwise(F.col("kind")))
    e = traffic.estimate(C._features(spark, d)).withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
    e = e.join(plan, ["lo", "hi"], "left").join(action, keys, "left").join(role, keys, "left")
    e = e.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("traffic", "interventions", "partition", "class")])))
    colour = display.street_colour(F.col("mode"), F.col("traffic_intensity"), F.lit(True), F.col("action"), F.col("role"), F.col("kind"), F.col("hierarchy"))
    return e.groupBy("mode", colour.alias("colour")).agg(F.count("*").alias("edges"), F.sum("u").alias("nodes"))


@query
def network_after_closures(spark, d):
    """The grid after filters, one-way streets in either direction, and closures."""
    s = C._simple(spark, d).where("lo % 7 = 0 or lo % 11 = 0 or lo % 13 = 0")
    kind = F.when(F.col("lo") % 7 == 0, "modal_filter").when(F.col("lo") % 13 == 0, "full_closure").otherwise("one_way")
    plan = s.select("lo", "hi", kind.alias("kind"), F.when(F.col("hi") % 2 == 0, "hi_to_lo").otherwise("lo_to_hi").alias("direction"))
    return access.apply_changes(S.edges(spark, d), plan).select("u", "v", "key", "length")
