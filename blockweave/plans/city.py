"""Registered queries of whole pipelines: city partition, block analysis, access, routes through blocks."""

from __future__ import annotations

from collections.abc import Callable
from json import dumps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.operators import access, blocks, graphs, lines, network, partition, polygonize, routing, spatial
from blockweave.plans import catalog as C
from blockweave.sources import geojson
from blockweave.sources import network as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _box(spark: SparkSession, d: str) -> tuple[float, float, float, float]:
    """West, south, east and north end of the network."""
    return tuple(S.nodes(spark, d).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return network.with_points(C._features(spark, d), S.nodes(spark, d))


def _central(spark: SparkSession, d: str, pivots: Callable[[int], int | None]) -> DataFrame:
    return graphs.betweenness(C._simple(spark, d), pivots)


def _arterials(spark: SparkSession, d: str) -> DataFrame:
    """Arterials by class, and by centrality in networks of more than a hundred nodes."""
    central = _central(spark, d, partition.partition_pivots) if S.nodes(spark, d).count() > partition.LEAST_NODES else None
    return partition.cut(partition.arterials(C._features(spark, d), central))


@query
def network_source(spark, d):
    """Streets for driving with an end in the western half of the network, of the largest component there."""
    west, south, east, north = _box(spark, d)
    edges, nodes = S.of_kind(S.edges(spark, d), "drive"), S.nodes(spark, d)
    inside = partition.cut(network.in_box(edges, nodes, north, south, (west + east) / 2, west))
    labels = graphs.components(network.simple(inside, F.col("length")))
    keep = network.largest_component(labels).select(F.col("node").alias("u"))
    return inside.join(keep, "u", "left_semi").select("u", "v", "key", "length")


@query
def arterial_network(spark, d):
    """Arterial edges by class or by centrality from the 75th percentile of streets on."""
    return C._features(spark, d).join(_arterials(spark, d), ["u", "v", "key"], "left_semi").select("u", "v", "key", "highway")


@query
def city_cells(spark, d):
    """Corners of the cells between arterials by class and the network's box."""
    made = partition.cells(_placed(spark, d), partition.arterials(C._features(spark, d)), _box(spark, d))
    side = lambda f, c: F.round(f(F.transform("ring", lambda p: p[c])), 7)
    return made.select(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed, chosen = partition.cut(_placed(spark, d)), _arterials(spark, d)
    return placed, chosen, partition.sized(partition.cells(placed, chosen, _box(spark, d)), placed, chosen)


@query
def city_cells_sized(spark, d):
    """Cells after merging small and splitting large ones."""
    return _sized(spark, d)[2].select("cell_id", F.round("area_ha", 4).alias("area_ha"), F.size("ring").alias("corners"))


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    placed, chosen, shapes = _sized(spark, d)
    links = partition.classify(placed, chosen, shapes)
    return shapes, links, *partition.enforced(shapes, links, C._features(spark, d), S.nodes(spark, d))


@query
def city_blocks(spark, d):
    """A row for each block of the city partition."""
    shapes, links, sectors, changes, lost = _blocks(spark, d)
    return partition.block_table(shapes, links, S.edges(spark, d), sectors, changes, lost)


@query
def city_partition(spark, d):
    """Totals of the city partition."""
    return partition.totals(city_blocks(spark, d), _box(spark, d))


@query
def city_modifications(spark, d):
    """A record for each street that the city partition changes."""
    changes = _blocks(spark, d)[3]
    return blocks.modification_records(changes, S.edges(spark, d), S.nodes(spark, d))


def _cell_state(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    links, sectors, changes = C._changed(spark, d)
    return links, sectors, changes, partition.cut(access.unreachable(links, sectors, changes))


@query
def access_diagnosis(spark, d):
    """Why nodes of cells can't be reached after the cells' changes."""
    links, sectors, changes, lost = _cell_state(spark, d)
    return access.diagnose(links, sectors, changes, lost, S.nodes(spark, d))


@query
def access_advice(spark, d):
    """What may open the cells with unreachable nodes."""
    return access.suggest(*_cell_state(spark, d))


@query
def network_stats(spark, d):
    """Nodes, edges, km, and the mean and largest centrality of edges."""
    central = C._analysis_centrality(spark, d)
    e = S.edges(spark, d).select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "length").join(central, ["lo", "hi"], "left").withColumn("c", F.coalesce("centrality", F.lit(0.0)))
    t = e.agg(F.count("*").alias("total_edges"), F.round(F.sum("length") / 1000, 2).alias("total_length_km"), F.round(F.avg("c"), 6).alias("mean_centrality"), F.round(F.max("c"), 6).alias("max_centrality"))
    return t.crossJoin(S.nodes(spark, d).agg(F.count("*").alias("total_nodes")))  # a row each


#: Hectares of blocks of the analysis, and the percentile of centrality from which streets are strong.
LEAST_HA, MOST_HA, PERCENTILE = 4, 25, 70


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored faces of important or central streets inside the area window, their edges by role, and their rings."""
    feats, nodes = partition.cut(C._features(spark, d)), S.nodes(spark, d)
    central = partition.cut(C._analysis_centrality(spark, d))
    both = feats.select("u", "v", "key", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).join(central, ["lo", "hi"], "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    least = network.index_percentile(both, "centrality", PERCENTILE).select(F.col("value").alias("least"))
    strong = central.join(F.broadcast(least), F.col("centrality") >= F.col("least"), "left_semi").select("lo", "hi")  # one row
    streets = network.simple(network.boundary_edges(feats), F.col("length_m")).select("lo", "hi").union(strong).distinct()
    shapes = polygonize.face_rings(streets, nodes).withColumn("area_ha", G.mercator_hectares(F.col("ring"))).where(F.col("area_ha").between(LEAST_HA, MOST_HA))
    shapes = partition.cut(shapes.select("cell_id", "ring"))
    links = lines.crossed_edges(network.with_points(feats, nodes), shapes)
    roles = links.withColumn("role", F.when(F.col("role") == "perimeter", "boundary").otherwise(F.col("role")))
    roles = partition.cut(roles)
    return partition.cut(blocks.score(shapes, roles, feats, central)), roles, shapes


def _ranked(scored: DataFrame) -> DataFrame:
    """The fifty best blocks, with their rank."""
    best = scored.orderBy(F.desc(F.round("total", 1)), "cell_id").limit(50)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("total", 1)), "cell_id")))  # fifty rows


@query
def analysis_candidates(spark, d):
    """The fifty best blocks of the analysis, with what follows from their scores."""
    return blocks.candidates(_ranked(_candidates(spark, d)[0]))


@query
def analysis_json(spark, d):
    """The fifty best blocks as JSON without empty parts."""
    return blocks.serialised(analysis_candidates(spark, d))


@query
def analysis_result(spark, d):
    """The whole result of the analysis as JSON: its parameters, the network's numbers, and the fifty best blocks in order."""
    scored, roles, shapes = _candidates(spark, d)
    feats, e = network.with_points(C._features(spark, d), S.nodes(spark, d)), S.edges(spark, d)
    best = partition.cut(_ranked(scored))
    made = blocks.results(best, shapes, roles, feats, e.select("u", "v", "key", "name"), geojson.polygon(F.col("ring")))
    row = lambda df, part, rank, json: df.select(F.lit(part).alias("part"), rank.alias("rank"), json.alias("json"))
    params = {"min_area_hectares": LEAST_HA, "max_area_hectares": MOST_HA, "centrality_threshold_percentile": PERCENTILE}
    first = F.lit(0)
    out = row(network_stats(spark, d), "network_stats", first, F.to_json(F.struct("*")))
    out = out.unionByName(row(spark.range(1), "analysis_params", first, F.lit(dumps(params))))
    return out.unionByName(row(made, "candidate", F.col("rank"), F.col("json")))


def _trips(spark: SparkSession, d: str) -> DataFrame:
    """From each even address to the next one."""
    a = S.addresses(spark, d)
    start = a.where("address_id % 2 = 0").select(F.col("address_id").alias("request_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return start.join(a.where("address_id % 2 = 1").select((F.col("address_id") - 1).alias("request_id"), F.col("x").alias("dx"), F.col("y").alias("dy")), "request_id")


def _block_routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links, _, changes = C._changed(spark, d)
    edges = partition.cut(access.apply_changes(S.edges(spark, d), changes))
    routes = routing.block_routes(_trips(spark, d), edges, S.nodes(spark, d), S.cells(spark, d), spatial.cell_entries(links))
    return partition.cut(routes), edges, links


@query
def block_routes(spark, d):
    """Routes between addresses that cross blocks on arterials only, after the blocks' changes."""
    return _block_routes(spark, d)[0].select("request_id", "success", "reason", F.round("cost", 3).alias("cost"), F.size("path").alias("n_nodes"), F.size("blocks").alias("n_blocks"))


@query
def block_route_segments(spark, d):
    """Runs of one road class and block of those routes."""
    routes, edges, links = _block_routes(spark, d)
    return routing.segments(routing.in_blocks(routing.steps(routes.where("success"), edges), links))


@query
def route_changes(spark, d):
    """Streets of free routes that are to change, in either direction."""
    steps = routing.steps(routing.shortest_paths(routing.priced(S.edges(spark, d)), C._requests(spark, d), S.nodes(spark, d)), S.edges(spark, d))
    return steps.select("request_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).join(C._planned(spark, d), ["lo", "hi"]).groupBy("request_id").agg(F.count("*").alias("streets"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
