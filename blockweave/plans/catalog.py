"""Registered queries of the street-network part; each reads the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions import roads as R
from blockweave.functions.lineage import cut
from blockweave.operators import access, blocks, cell_merge, display, graphs, network, noding, places, polygonize, routing, sizing, spatial, traffic
from blockweave.plans.oracle import ORACLE_SQL  # noqa: F401
from blockweave.sources import network as S
from blockweave.sources import geojson, result_cache
from blockweave.streaming import road_state, traffic_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _features(spark: SparkSession, d: str) -> DataFrame:
    return network.features(S.edges(spark, d))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return network.with_points(S.edges(spark, d), S.nodes(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return spatial.cell_edges(_placed(spark, d), S.cells(spark, d))


def _sectors(spark: SparkSession, d: str, links: DataFrame) -> DataFrame:
    return blocks.entry_sectors(spatial.cell_entries(links), S.cells(spark, d), S.nodes(spark, d))


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, sectors and street changes of the cells, each made once."""
    links = _links(spark, d)
    sectors = cut(_sectors(spark, d, links))
    return links, sectors, cut(blocks.street_changes(links, sectors, _features(spark, d)))


def _simple(spark: SparkSession, d: str) -> DataFrame:
    return network.simple(S.edges(spark, d), F.col("length"), "length")


def _analysis_centrality(spark: SparkSession, d: str) -> DataFrame:
    """Centralities of the analysis, which by its definition has some of the nodes as sources in large networks."""
    return graphs.betweenness(_simple(spark, d), graphs.analysis_pivots)


@query
def network_features(spark, d):
    return _features(spark, d)


@query
def network_class_totals(spark, d):
    return network.class_totals(_features(spark, d))


@query
def network_totals(spark, d):
    return network.totals(_features(spark, d))


@query
def network_in_box(spark, d):
    return network.in_box(S.edges(spark, d), S.nodes(spark, d), 47.515, 47.505, 19.02, 19.005).select("u", "v", "key", "length")


@query
def traffic_features(spark, d):
    return traffic.estimate(_features(spark, d)).select("u", "v", "key", "capacity", "estimated_load", "estimated_volume", "traffic_intensity")


@query
def traffic_estimate(spark, d):
    return traffic.by_class(traffic.estimate(_features(spark, d)))


@query
def traffic_totals(spark, d):
    return traffic.totals(traffic.estimate(_features(spark, d)))


@query
def traffic_real_counts(spark, d):
    out = traffic.with_counts(traffic.estimate(_features(spark, d)), S.traffic_counts(spark, d))
    return out.select("u", "v", "key", "estimated_load", "estimated_volume", "traffic_intensity", "is_real_data")


@query
def simple_graph(spark, d):
    return _simple(spark, d)


@query
def simple_first_length(spark, d):
    return network.first_length(S.edges(spark, d))


@query
def simple_cut_cost(spark, d):
    return network.simple(S.edges(spark, d), R.cut_cost(R.road_class(F.col("highway"))), "cost")


@query
def node_degree(spark, d):
    return network.degree(S.edges(spark, d))


@query
def length_percentile_70(spark, d):
    return network.index_percentile(S.edges(spark, d), "length", 70)


@query
def length_percentile_75_simple(spark, d):
    return network.index_percentile(_simple(spark, d), "length", 75)


@query
def boundary_edges(spark, d):
    return network.boundary_edges(_features(spark, d)).select("u", "v", "key", "highway")


@query
def arterial_edges(spark, d):
    return network.arterial_edges(_features(spark, d)).select("u", "v", "key", "highway")


@query
def cell_areas(spark, d):
    c, mid = S.cells(spark, d), G.centroid(F.col("ring"))
    return c.select("cell_id", F.round(G.mercator_hectares(F.col("ring")), 4).alias("mercator_ha"), F.round(G.roundness(F.col("ring")), 6).alias("roundness"), F.round(mid["x"], 6).alias("cx"), F.round(mid["y"], 6).alias("cy"))


@query
def cell_edges(spark, d):
    return _links(spark, d)


@query
def cell_entries(spark, d):
    return spatial.cell_entries(_links(spark, d))


@query
def cell_adjacency(spark, d):
    return spatial.adjacent_cells(S.cells(spark, d))


@query
def address_cell(spark, d):
    return spatial.points_in_cells(S.addresses(spark, d), S.cells(spark, d)).select("address_id", "cell_id")


@query
def address_nearest_node(spark, d):
    return spatial.nearest(S.addresses(spark, d), S.nodes(spark, d), "address_id").select("address_id", "node_id")


@query
def cell_sectors(spark, d):
    return _sectors(spark, d, _links(spark, d))


@query
def cell_interventions(spark, d):
    feats = _features(spark, d).join(_placed(spark, d).select("u", "v", "key", "ux", "uy", "vx", "vy"), ["u", "v", "key"])
    return blocks.interventions(S.cells(spark, d), _links(spark, d), feats)


@query
def cell_street_changes(spark, d):
    return _changed(spark, d)[2]


@query
def cell_scores(spark, d):
    return blocks.score(S.cells(spark, d), _links(spark, d), _features(spark, d), _analysis_centrality(spark, d)).drop("c_edge", "c_inner", "walk_m")


@query
def impact_summary(spark, d):
    return display.impact(cell_scores(spark, d))


@query
def direction_histogram(spark, d):
    return sizing.histogram(_placed(spark, d))


@query
def size_recommendation(spark, d):
    return sizing.recommend(sizing.grid(_placed(spark, d), S.nodes(spark, d).count()), 9000.0, 47.5)


@query
def edge_betweenness(spark, d):
    """Shares of all shortest paths, from all nodes."""
    return graphs.betweenness(_simple(spark, d))


@query
def components(spark, d):
    return graphs.components(_simple(spark, d))


@query
def component_reach(spark, d):
    links = _simple(spark, d)
    arcs = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return graphs.hops(arcs, S.nodes(spark, d).where("cx = 0 and cy = 0").select(F.col("node_id").alias("node")), 6)


@query
def entry_reach(spark, d):
    """Directed hops from the nearest entry of any cell, of all nodes that entries reach."""
    return graphs.hops(S.edges(spark, d).select("u", "v").distinct(), cell_entries(spark, d).select(F.col("node_id").alias("node")))


@query
def block_faces(spark, d):
    arterial = network.arterial_edges(_features(spark, d))
    return polygonize.faces(network.simple(arterial, F.col("length_m")), S.nodes(spark, d))


@query
def block_faces_summary(spark, d):
    return block_faces(spark, d).where("area2 > 0 and n_edges = 16").agg(F.count("*").alias("full_cells"))


def _requests(spark, d):
    near = address_nearest_node(spark, d)
    odd = near.where("address_id % 2 = 1").select((F.col("address_id") - 1).alias("request_id"), F.col("node_id").alias("destination"))
    return near.where("address_id % 2 = 0").select(F.col("address_id").alias("request_id"), F.col("node_id").alias("origin")).join(odd, "request_id")


@query
def route_costs(spark, d):
    return routing.shortest_paths(routing.priced(S.edges(spark, d)), _requests(spark, d), S.nodes(spark, d)).select("request_id", "cost", F.size("path").alias("n_nodes"))


@query
def route_segments(spark, d):
    edges = S.edges(spark, d)
    return routing.segments(routing.steps(routing.shortest_paths(routing.priced(edges), _requests(spark, d), S.nodes(spark, d)), edges))


@query
def route_summary(spark, d):
    return routing.route_totals(route_segments(spark, d))


@query
def place_search(spark, d):
    return places.search(S.gazetteer(spark, d), "district 1")


@query
def place_short_names(spark, d):
    return places.short_name(S.gazetteer(spark, d))


def _cache_index(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "network").when(k % 3 == 1, "analysis").otherwise("search")
    params = F.concat(F.lit('{"id": '), k.cast("string"), F.lit("}"))
    return S.table(spark, d, "supplier").select("s_suppkey", kind.alias("cache_type"), params.alias("params"), F.col("s_name").alias("data"), (F.lit(1700000000.0) + k * 60).alias("created_at"), ((k % 5) * 600).alias("ttl_seconds"), result_cache.key_of(kind, params).alias("cache_key"))


@query
def cache_stats(spark, d):
    return result_cache.stats(_cache_index(spark, d))


@query
def cache_live(spark, d):
    return result_cache.live(_cache_index(spark, d), F.lit(1700003600.0)).select("s_suppkey", "cache_key")


@query
def progress_events(spark, d):
    e = S.table(spark, d, "events").select(F.lit("progress").alias("type"), F.col("event_type").alias("stage"), (F.col("event_id") % 101).cast("int").alias("percent"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"))
    return display.parse_events(display.event_text(e))


@query
def traffic_colours(spark, d):
    return traffic.estimate(_features(spark, d)).select("u", "v", "key", display.traffic_colour(F.col("traffic_intensity")).alias("colour"))


@query
def hourly_traffic(spark, d):
    return traffic_stream.hourly_counts(S.table(spark, d, "events"))


@query
def edge_ids(spark, d):
    e = S.edges(spark, d)
    return e.select("u", "v", "key", R.positive_id(F.col("osmid")).alias("first_id"), F.explode(F.filter("osmid", lambda x: x > 0)).alias("osmid"))


@query
def edge_lengths_on_sphere(spark, d):
    return _placed(spark, d).select("u", "v", "key", F.round(G.haversine(F.col("uy"), F.col("ux"), F.col("vy"), F.col("vx")), 3).alias("metres"))


@query
def cell_area_models(spark, d):
    r = F.col("ring")
    low, high = F.get(r, F.lit(0)), F.get(r, F.lit(2))
    return S.cells(spark, d).select("cell_id", F.round(G.box_hectares(high["y"], low["y"], high["x"], low["x"]), 4).alias("box_ha"), F.round(G.approximate_hectares(r), 4).alias("approximate_ha"))


@query
def cell_geojson(spark, d):
    text = S.cells(spark, d).select("cell_id", geojson.to_polygon(F.col("ring")).alias("text"))
    back = text.select("cell_id", geojson.from_polygon(F.col("text")).alias("ring"))
    return back.select("cell_id", F.size("ring").alias("points"), F.get("ring", F.lit(2))["x"].alias("x"), F.get("ring", F.lit(2))["y"].alias("y"))


@query
def cell_simple_scores(spark, d):
    counts = _links(spark, d).groupBy("cell_id").agg(F.count(F.when(F.col("role") == "interior", 1)).alias("i"), F.count(F.when(F.col("role") == "boundary", 1)).alias("b"))
    c = S.cells(spark, d).join(counts, "cell_id")
    return c.select("cell_id", blocks.simple_score(G.mercator_hectares(F.col("ring")), F.col("i"), F.col("b"), G.roundness(F.col("ring"))).alias("score"))


@query
def cell_sector_counts(spark, d):
    return cell_sectors(spark, d).groupBy("cell_id", "sector").agg(F.count("*").alias("entries"))


def _planned(spark, d):
    """Changes by arithmetic: filters where lo is divisible by 7, one-way streets where it is by 11."""
    s = _simple(spark, d).where("lo % 7 = 0 or lo % 11 = 0")
    return s.select("lo", "hi", F.when(F.col("lo") % 7 == 0, "modal_filter").otherwise("one_way").alias("kind"))


@query
def network_after_changes(spark, d):
    return access.apply_changes(S.edges(spark, d), _planned(spark, d)).select("u", "v", "key", "length")


@query
def cell_violations(spark, d):
    links = _links(spark, d)
    return access.violations(links, _sectors(spark, d, links))


@query
def cell_directed_violations(spark, d):
    """Entries of other sectors that can be driven to inside a cell, by sectors."""
    links = _links(spark, d)
    return access.directed_violations(links, _sectors(spark, d, links))


@query
def cell_violation_paths(spark, d):
    """An example path for each two sectors of a cell that its inner streets join."""
    links = _links(spark, d)
    p = access.violation_paths(links, _sectors(spark, d, links))
    return p.select("cell_id", "sector_a", "sector_b", "streets", F.array_join(F.transform("path", lambda n: n.cast("string")), ",").alias("path"))


@query
def cell_violations_after_changes(spark, d):
    return access.violations(*_changed(spark, d))


@query
def cell_access_report(spark, d):
    links, sectors, changes = _changed(spark, d)
    return access.report(links, access.unreachable(links, sectors, changes))


@query
def city_totals(spark, d):
    links, sectors, changes = _changed(spark, d)
    areas = S.cells(spark, d).select(G.utm_hectares(F.col("ring")).alias("area_ha"))
    return access.city_totals(areas, changes, access.unreachable(links, sectors, changes))


@query
def routes_after_changes(spark, d):
    edges = access.apply_changes(S.edges(spark, d), _planned(spark, d))
    return routing.shortest_paths(routing.priced(edges), _requests(spark, d), S.nodes(spark, d)).select("request_id", "cost")


@query
def progress_display(spark, d):
    e = S.table(spark, d, "events").select("event_id", (F.col("event_id") % 300).cast("double").alias("elapsed"), (F.col("event_id") % 101).cast("double").alias("percent"))
    left = display.remaining(F.col("elapsed"), F.col("percent"), 90.0)
    return e.select("event_id", F.round(left, 3).alias("remaining"), display.clock(F.col("elapsed")).alias("clock"), display.score_band(F.col("percent")).alias("band"), display.palette_index(F.col("event_id")).alias("colour"))


@query
def traffic_sessions(spark, d):
    return traffic_stream.sessions(S.table(spark, d, "events"))


@query
def road_runs(spark, d):
    """Runs of a road's events without a gap of more than half an hour."""
    return road_state.road_runs(S.table(spark, d, "events"))


@query
def sliding_traffic(spark, d):
    return traffic_stream.hourly_counts(S.table(spark, d, "events"), width="1 hour", slide="30 minutes")


@query
def detected_blocks(spark, d):
    """Faces of the streets that are important or central enough, inside the area window."""
    feats, nodes = _features(spark, d), S.nodes(spark, d)
    central = _analysis_centrality(spark, d)
    least = network.index_percentile(central, "centrality", 70).select(F.col("value").alias("least"))
    strong = central.join(F.broadcast(least), F.col("centrality") >= F.col("least"), "left_semi").select("lo", "hi")  # one row
    edge = network.simple(network.boundary_edges(feats), F.col("length_m")).select("lo", "hi").union(strong).distinct()
    metres = F.col("area2") / 2 * 111320 * 111320 * F.cos(F.radians(F.lit(47.5)))
    return polygonize.faces(edge, nodes).where("area2 > 0").select("face_id", "n_edges", (metres / 10000).alias("area_ha")).where("area_ha between 4 and 25")


@query
def noded_diagonals(spark, d):
    """Both diagonals of each block, split where they cross."""
    n = S.nodes(spark, d)
    at = lambda dx, dy, i: n.select((F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    here = n.select("node_id", "cx", "cy", "x", "y")
    up = here.join(at(1, 1, 2), ["cx", "cy"]).select((F.col("node_id") * 2).alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    down = here.join(at(1, 0, 1), ["cx", "cy"]).join(at(0, 1, 2), ["cx", "cy"]).select((F.col("node_id") * 2 + 1).alias("seg_id"), "x1", "y1", "x2", "y2")
    return noding.split_at_crossings(up.unionByName(down)).select("seg_id", "piece", F.round("x1", 9).alias("x1"), F.round("y1", 9).alias("y1"))


@query
def merged_cells(spark, d):
    """Cells of about 8 hectares, merged towards 16."""
    areas = S.cells(spark, d).select("cell_id", G.utm_hectares(F.col("ring")).alias("ha"))
    return cell_merge.merge_small(areas, cell_adjacency(spark, d), least=10.0, most=20.0, target=16.0)


@query
def top_cells(spark, d):
    return cell_simple_scores(spark, d).orderBy(F.desc("score"), "cell_id").limit(20)


@query
def street_status(spark, d):
    """What a map shows first of each street: a planned change, perimeter, interior, or its class."""
    role = _links(spark, d).groupBy("u", "v", "key").agg(F.max((F.col("role") == "boundary").cast("int")).alias("edge"))
    e = _features(spark, d).withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
    e = e.join(_planned(spark, d), ["lo", "hi"], "left").join(role, ["u", "v", "key"], "left")
    status = F.coalesce("kind", F.when(F.col("edge") == 1, "perimeter").when(F.col("edge") == 0, "interior"), "highway")
    return e.select("u", "v", "key", status.alias("status"))


@query
def arterial_ids(spark, d):
    return network.arterial_edges(_features(spark, d)).select("osmid").distinct()


@query
def change_counts(spark, d):
    return _planned(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query
def sector_suggestions(spark, d):
    return S.cells(spark, d).select("cell_id", sizing.sector_count(G.approximate_hectares(F.col("ring"))).alias("sectors"))


@query
def stages_of_events(spark, d):
    kinds = F.element_at(F.array(*[F.lit(s) for s in display.STAGES]), (F.col("event_id") % 6 + 1).cast("int"))
    return S.table(spark, d, "events").groupBy(display.stage_number(kinds).alias("step")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query
def one_way_directions(spark, d):
    """Directions for all inner streets."""
    links = _links(spark, d)
    inner = links.where("role = 'interior'").select("cell_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    return access.one_way_directions(links, _sectors(spark, d, links), inner)
