"""Registered queries of single operators: what maps, forms and reports show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions import roads as R
from blockweave.operators import access, blocks, display, lines, network, noding, partition, places, spatial
from blockweave.plans import catalog as C
from blockweave.sources import geojson, partition_store
from blockweave.sources import network as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def street_names(spark, d):
    return S.edges(spark, d).select("u", "v", "key", R.joined_name(F.col("name")).alias("joined"), R.first_text(F.col("name")).alias("first"))


@query
def box_checks(spark, d):
    a = S.addresses(spark, d)
    half = ((F.col("address_id") % 9) - 1) / F.lit(16.0)
    box = a.select("address_id", (F.col("y") + half).alias("n"), (F.col("y") - half).alias("s"), (F.col("x") + half).alias("e"), (F.col("x") - half).alias("w"))
    return box.select("address_id", network.valid_box(F.col("n"), F.col("s"), F.col("e"), F.col("w")).alias("reason"))


@query
def box_keys(spark, d):
    a = S.addresses(spark, d)
    return a.select("address_id", partition_store.box_key(F.col("y") + 0.01, F.col("y") - 0.01, F.col("x") + 0.01, F.col("x") - 0.01).alias("box_key"))


@query
def address_first_box(spark, d):
    """The first of four boxes that holds an address and the point east of it."""
    gw, _ = S.grid_width(spark, d)
    rows = [(k, 19.0 + k * gw / 8192.0, 47.5, 19.0 + (k + 4) * gw / 8192.0, 47.5 + gw * 5 / 8192.0) for k in range(0, 8, 2)]
    boxes = spark.createDataFrame(rows, "box_id long, west double, south double, east double, north double")
    a = S.addresses(spark, d).select(F.col("address_id").alias("request_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("x") + 1 / 1024).alias("dx"), F.col("y").alias("dy"))
    return partition_store.first_box(a, boxes)


def _lines(spark, d):
    e = network.with_points(S.edges(spark, d).select("u", "v", "key"), S.nodes(spark, d)).join(S.geometries(spark, d), ["u", "v", "key"], "left")
    return e.select("u", "v", "key", display.line_of(F.col("geom"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")).alias("line"))


@query
def edge_lines(spark, d):
    mid = display.midpoint(F.col("line"))
    return _lines(spark, d).select("u", "v", "key", F.size("line").alias("points"), mid["x"].alias("x"), mid["y"].alias("y"))


@query
def edge_arrows(spark, d):
    return _lines(spark, d).select("u", "v", "key", F.posexplode(display.arrow_places(F.size("line"))).alias("k", "place")).select("u", "v", "key", "k", "place")


@query
def road_styles(spark, d):
    colour, width = display.road_style(F.col("hierarchy"))
    return C._features(spark, d).select("u", "v", "key", colour.alias("colour"), width.alias("width"))


@query
def coupled_limits(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("low"), F.lit(25.0).alias("high"))
    a, b = display.coupled(F.col("low"), F.col("high"), 2.0, "low")
    c, e = display.coupled(F.col("low"), F.col("high"), 1.0, "high")
    return p.select("p_partkey", a.alias("low_moved_low"), b.alias("low_moved_high"), c.alias("high_moved_low"), e.alias("high_moved_high"))


@query
def cell_status(spark, d):
    return S.cells(spark, d).select("cell_id", display.block_status(F.col("cell_id") % 3 != 0, F.col("cell_id") % 8 != 0).alias("status"))


@query
def entry_labels(spark, d):
    """Entries of each cell with their number in it, and a short id that is always the same."""
    e = C.cell_entries(spark, d)
    short = F.substring(F.sha2(F.concat_ws("_", F.col("cell_id").cast("string"), F.col("node_id").cast("string")), 256), 1, 8)
    return e.select("cell_id", "node_id", (F.row_number().over(W.partitionBy("cell_id").orderBy("node_id")) - 1).alias("ordinal"), short.alias("id"))


@query
def flagged_edges(spark, d):
    return access.flagged(S.edges(spark, d).select("u", "v", "key"), C._planned(spark, d))


@query
def open_edges(spark, d):
    return flagged_edges(spark, d).where("not vehicle_blocked").select("u", "v", "key")


@query
def changed_streets(spark, d):
    """Streets whose id a plan names, by kind."""
    first = S.edges(spark, d).select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.get("osmid", F.lit(0)).alias("osmid"))
    ids = C._planned(spark, d).join(first, ["lo", "hi"]).select("osmid", "kind").distinct()
    return C._features(spark, d).join(ids, "osmid").select("u", "v", "key", "osmid", "kind")


@query
def last_changes(spark, d):
    """Of several changes of one road the last one holds, of several interventions the first."""
    e = S.table(spark, d, "events").select((F.col("user_id") * 4).alias("osmid"), F.col("event_type").alias("kind"), "ts", "event_id")
    return e.groupBy("osmid").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"), F.min_by("kind", F.struct("ts", "event_id")).alias("first_kind"))


@query
def cell_touching_edges(spark, d):
    return lines.crossed_edges(network.with_points(C._features(spark, d), S.nodes(spark, d)), S.cells(spark, d))


@query
def cell_boundary_ids(spark, d):
    e = S.edges(spark, d).select("u", "v", "key", F.explode(F.filter("osmid", lambda i: i > 0)).alias("osmid"))
    return C._links(spark, d).where("role = 'boundary'").join(e, ["u", "v", "key"]).groupBy("cell_id").agg(F.sort_array(F.collect_set("osmid")).alias("boundary_roads"))


@query
def cell_entries_near(spark, d):
    """Entries by common nodes or by nearness to the outline."""
    return partition.entries(C._links(spark, d), S.cells(spark, d), S.nodes(spark, d))


@query
def address_nearest_entry(spark, d):
    e = C.cell_entries(spark, d).select("node_id").distinct().join(S.nodes(spark, d).select("node_id", "x", "y"), "node_id")
    return spatial.nearest(S.addresses(spark, d), e, "address_id").select("address_id", "node_id")


@query
def address_reverse(spark, d):
    return places.reverse(S.addresses(spark, d), S.gazetteer(spark, d), "address_id")


@query
def intervention_counts(spark, d):
    kinds = ["no_change", "one_way", "pedestrianize", "modal_filter", "local_access"]
    return C.cell_interventions(spark, d).groupBy("cell_id").agg(*[F.count(F.when(F.col("action") == k, 1)).alias(k) for k in kinds])


@query
def intervention_access(spark, d):
    """Who may still use the streets of each intervention."""
    return C.cell_interventions(spark, d).groupBy("action").agg(F.count("*").alias("n")).select("action", "n", F.array_join(blocks.access_allowed(F.col("action")), ", ").alias("allowed"))


@query
def inner_components(spark, d):
    return access.inner_components(C._links(spark, d), C._planned(spark, d).join(C._links(spark, d).select("cell_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), ["lo", "hi"]))


@query
def component_counts(spark, d):
    return inner_components(spark, d).groupBy("cell_id").agg(F.countDistinct("label").alias("areas"), F.count("*").alias("nodes"))


@query
def inner_subgraph(spark, d):
    """Edges with both ends among the nodes whose coordinates in the grid are both odd or both even."""
    keep = S.nodes(spark, d).where("cx % 2 = cy % 2 or cx % 3 = 0").select("node_id")
    e = S.edges(spark, d).select("u", "v", "key")
    return e.join(keep.withColumnRenamed("node_id", "u"), "u", "left_semi").join(keep.withColumnRenamed("node_id", "v"), "v", "left_semi").select("u", "v", "key")


@query
def event_type_runs(spark, d):
    """Events of a user that differ from the one before."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = S.table(spark, d, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(by).alias("before"))
    return e.where("before is null or before <> event_type").select("user_id", "event_id", "event_type")


@query
def cell_change_kinds(spark, d):
    links = C._links(spark, d).select("cell_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()
    return links.join(C._planned(spark, d), ["lo", "hi"]).groupBy("cell_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))


@query
def address_circles(spark, d):
    ring = G.circle(F.col("x"), F.col("y"), 100.0)
    return S.addresses(spark, d).select("address_id", F.size(ring).alias("points"), F.round(F.get(ring, F.lit(0))["x"], 9).alias("x"), F.round(F.get(ring, F.lit(0))["y"], 9).alias("y"))


@query
def row_lines_thinned(spark, d):
    """The line of each row of nodes, thinned to its ends."""
    line = S.nodes(spark, d).groupBy("cy").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("line"))
    thin = noding.simplify()(F.col("line"))
    return line.select("cy", F.size("line").alias("before"), thin.alias("thin")).select("cy", "before", F.size("thin").alias("after"), F.get("thin", F.lit(0))["x"].alias("x0"), F.element_at("thin", -1)["x"].alias("x1"))


@query
def cell_feature_texts(spark, d):
    """Cells as GeoJSON features, read back."""
    text = S.cells(spark, d).select(geojson.feature(F.col("ring"), F.struct("cell_id", F.size("ring").alias("points"))).alias("text"))
    at = lambda p: F.get_json_object("text", p)
    return text.select(at("$.properties.cell_id").cast("long").alias("cell_id"), at("$.properties.points").cast("int").alias("points"), at("$.type").alias("type"), at("$.geometry.coordinates[0][2][0]").cast("double").alias("x"))


@query
def edge_kinds_of_network(spark, d):
    """Edges for driving, cycling and walking."""
    e = S.edges(spark, d)
    parts = [S.of_kind(e, k).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("drive", "bike", "walk", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
