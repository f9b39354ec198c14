"""Scores, interventions, sectors and street changes of blocks."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions import roads as R
from blockweave.functions.lineage import cut
from blockweave.operators.access import one_way_directions


def size_score(ha: Column) -> Column:
    return F.when(ha.between(9, 16), 100.0).when(ha < 9, F.greatest(F.lit(0.0), 100 - 15 * (9 - ha))).otherwise(F.greatest(F.lit(0.0), 100 - 10 * (ha - 16)))


def walk_score(metres: Column, access: Column) -> Column:
    s = F.when(metres <= 200, 100.0).when(metres <= 300, 80.0).when(metres <= 400, 60.0).otherwise(F.greatest(F.lit(0.0), 100 - 0.2 * (metres - 200)))
    return F.when(access >= 8, F.least(F.lit(100.0), s + 10)).otherwise(s)


def density_score(interior: Column, ha: Column) -> Column:
    d = interior / ha
    return F.when(interior == 0, 30.0).when(d >= 3, 100.0).when(d >= 2, 80.0).when(d >= 1, 60.0).otherwise(40.0)


def boundary_score(cap: Column) -> Column:
    return F.when(cap >= 5000, 100.0).when(cap >= 3000, 80.0).when(cap >= 1500, 60.0).otherwise(F.greatest(F.lit(20.0), cap / 50))


def simple_score(ha: Column, interior: Column, perimeter: Column, round_: Column) -> Column:
    """Score from area, road counts and compactness alone, 0 to 100."""
    s = F.lit(50) + F.when(ha.between(9, 16), 20).when(ha.between(6, 20), 10).when((ha < 4) | (ha > 25), -10).otherwise(0)
    s = s + F.when(interior == 0, 15).when(interior <= 5, 10).when(interior <= 10, 5).when(interior > 20, -10).otherwise(0)
    s = s + F.when(perimeter >= 4, 10).when(perimeter < 2, -15).otherwise(0)
    s = s + F.when(round_ > 0.7, 10).when(round_ > 0.5, 5).when(round_ < 0.3, -5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), s))


def score(cells: DataFrame, links: DataFrame, feats: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """Six criteria, their weighted total and the mean centralities of each cell (cell_id, ring), from its edges by role.

    feats have u, v, key, osmid, highway and lanes; centrality has lo, hi, centrality (0 where missing).
    Perimeters count 30 roads at most and interiors 50, as the score defines.
    """
    e = links.join(feats, ["u", "v", "key"]).withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
    e = e.join(centrality, ["lo", "hi"], "left").withColumn("c", F.coalesce("centrality", F.lit(0.0))) if centrality is not None else e.withColumn("c", F.lit(0.0))
    edge, inner = F.col("role") == "boundary", F.col("role") == "interior"
    agg = e.groupBy("cell_id").agg(
        F.least(F.countDistinct(F.when(edge, F.col("osmid"))), F.lit(30)).alias("perimeter"), F.least(F.countDistinct(F.when(inner, F.col("osmid"))), F.lit(50)).alias("interior"),
        F.avg(F.when(edge, F.col("c"))).alias("c_edge"), F.avg(F.when(inner, F.col("c"))).alias("c_inner"),
        F.sum(F.when(edge, R.lookup(R.SCORE_CAPACITY, F.col("highway"), 200) * F.col("lanes"))).alias("cap"),
    )
    t = cells.join(agg, "cell_id").withColumn("area_ha", G.mercator_hectares(F.col("ring"))).withColumn("mid", G.centroid(F.col("ring")))
    metres = G.boundary_distance(F.col("ring"), F.col("mid.x"), F.col("mid.y")) * 111000 * F.cos(F.radians(F.col("mid.y")))
    t = t.withColumns({
        "size": size_score(F.col("area_ha")), "shape": 100 * G.roundness(F.col("ring")),
        "traffic": F.when(F.coalesce("c_edge", F.lit(0.0)) > 0, F.greatest(F.lit(0.0), 100 - 100 * F.coalesce("c_inner", F.lit(0.0)) / F.col("c_edge"))).otherwise(50.0),
        "access": walk_score(metres, F.least("perimeter", F.lit(20))), "density": density_score(F.col("interior"), F.col("area_ha")), "edge": boundary_score(F.coalesce("cap", F.lit(0))),
    })
    total = 0.15 * F.col("size") + 0.10 * F.col("shape") + 0.25 * F.col("traffic") + 0.20 * F.col("access") + 0.15 * F.col("density") + 0.15 * F.col("edge")
    return t.select("cell_id", "area_ha", "perimeter", "interior", "size", "shape", "traffic", "access", "density", "edge", total.alias("total"), F.coalesce("c_edge", F.lit(0.0)).alias("c_edge"), F.coalesce("c_inner", F.lit(0.0)).alias("c_inner"), metres.alias("walk_m"))


def interventions(cells: DataFrame, links: DataFrame, feats: DataFrame) -> DataFrame:
    """What to do with each edge of a cell: (cell_id, u, v, key, action, direction)."""
    e = links.join(feats, ["u", "v", "key"]).join(cells.select("cell_id", G.centroid(F.col("ring")).alias("mid"), F.sqrt(F.abs(G.signed_area(F.col("ring")))).alias("side")), "cell_id")
    far = F.sqrt(F.pow((F.col("ux") + F.col("vx")) / 2 - F.col("mid.x"), 2.0) + F.pow((F.col("uy") + F.col("vy")) / 2 - F.col("mid.y"), 2.0)) / F.col("side")
    rank = R.rank(F.col("highway"), "analysis")
    action = F.when(F.col("role") == "boundary", "no_change").when(rank <= 5, "one_way").when(far < 0.3, "pedestrianize").when(rank >= 7, "modal_filter").otherwise("local_access")
    return e.select("cell_id", "u", "v", "key", action.alias("action"), F.when(action == "one_way", F.when(F.pmod("osmid", F.lit(2)) == 0, "forward").otherwise("backward")).alias("direction"))


def entry_sectors(entries: DataFrame, cells: DataFrame, nodes: DataFrame, k: int = 4) -> DataFrame:
    """(cell_id, node_id, sector) of entries, around the cell's centroid."""
    mid = cells.select("cell_id", G.centroid(F.col("ring")).alias("mid"))
    e = entries.join(mid, "cell_id").join(nodes.select("node_id", "x", "y"), "node_id")
    return e.select("cell_id", "node_id", G.sector(F.col("x"), F.col("y"), F.col("mid.x"), F.col("mid.y"), k).alias("sector"))


def min_cut(links: list[tuple[int, int, float]], sources: set[int], sinks: set[int]) -> tuple[float, list[tuple[int, int]]]:
    """Cheapest undirected links whose removal parts sources from sinks, those nearest to the sinks of equals."""
    room: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, c in links:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    start, goal = object(), object()
    for s in sources:
        room[start][s], room[s][start] = float("inf"), 0.0
    for t in sinks:
        room[t][goal], room[goal][t] = float("inf"), 0.0
    total = 0.0
    while True:
        came, queue = {start: None}, deque([start])
        while queue and goal not in came:
            v = queue.popleft()
            for w, c in room[v].items():
                if c > 1e-12 and w not in came:
                    came[w] = v
                    queue.append(w)
        if goal not in came:
            break
        path, v = [], goal
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        least = min(room[a][b] for a, b in path)
        if least == float("inf"):
            return least, []
        total += least
        for a, b in path:
            room[a][b] -= least
            room[b][a] += least
    # The sink's side: nodes that can still reach it.
    side, queue = {goal}, deque([goal])
    while queue:
        w = queue.popleft()
        for v in list(room[w]):
            if v not in side and room[v].get(w, 0.0) > 1e-12:
                side.add(v)
                queue.append(v)
    return total, sorted({(min(a, b), max(a, b)) for a, b, _ in links if (a in side) != (b in side)})


def street_changes(links: DataFrame, sectors: DataFrame, feats: DataFrame) -> DataFrame:
    """(cell_id, lo, hi, kind, cost, direction): cuts that part the entries of each two sectors of a cell.

    One group for each cell, whose size is bounded by the cell's; a one-way street takes
    the place of a filter on important roads, and its direction, lo_to_hi or hi_to_lo, is
    decided here for all that work with the change.
    """
    inner = links.where("role = 'interior'").join(feats.select("u", "v", "key", "highway"), ["u", "v", "key"])
    inner = inner.groupBy("cell_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min(R.cut_cost(F.col("highway"))).cast("double").alias("cost"))
    rows = inner.withColumn("sector", F.lit(None).cast("int")).unionByName(sectors.select("cell_id", F.col("node_id").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(0.0).alias("cost"), "sector"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        doors = pdf[pdf["sector"].notna()]
        edges = [(int(a), int(b), float(c)) for a, b, c in pdf.loc[pdf["sector"].isna(), ["lo", "hi", "cost"]].itertuples(index=False)]
        known = {x for a, b, _ in edges for x in (a, b)}
        groups = {s: {int(v) for v in g["lo"]} & known for s, g in doors.groupby("sector")}
        cost = {(a, b): c for a, b, c in edges}
        out: set[tuple[int, int]] = set()
        for s in sorted(groups):
            for t in sorted(groups):
                if s < t and groups[s] and groups[t]:
                    out |= set(min_cut(edges, groups[s], groups[t])[1])
        cell = int(pdf["cell_id"].iloc[0])
        return pd.DataFrame([(cell, a, b, "one_way" if cost[a, b] >= 6 else "modal_filter", cost[a, b]) for a, b in sorted(out)], columns=["cell_id", "lo", "hi", "kind", "cost"])

    changes = cut(rows.groupBy("cell_id").applyInPandas(solve, "cell_id long, lo long, hi long, kind string, cost double"))
    ways = one_way_directions(links, sectors, changes.where("kind = 'one_way'").select("cell_id", "lo", "hi"))
    return changes.join(ways.drop("score"), ["cell_id", "lo", "hi"], "left")


# Who may still use a street, by what is done to it.
ACCESS = {"no_change": ["all"], "one_way": ["residents", "delivery", "emergency"], "pedestrianize": ["emergency", "delivery_hours"], "modal_filter": ["bicycle", "emergency"], "local_access": ["residents", "delivery", "emergency"]}


# Why a street is changed or not, as results must say it.
RATIONALE = {
    "no_change": "Boundary road - maintains through traffic capacity", "one_way": "Converted to one-way for local access only", "pedestrianize": "Central location - full pedestrianization",
    "modal_filter": "Modal filter - allows cycling and emergency access", "local_access": "Local access only - no through traffic",
}


def rationale(action: Column) -> Column:
    return F.coalesce(*[F.when(action == k, F.lit(v)) for k, v in RATIONALE.items()])


def access_allowed(action: Column) -> Column:
    return F.coalesce(*[F.when(action == k, F.array(*[F.lit(w) for w in who])) for k, who in ACCESS.items()])


def modification_records(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A record for each changed street: cell_id, u, v, osm_id, name, modification_type, direction, filter_x, filter_y.

    The first edge (u, v, key) of the street gives its id and name; a filter stands in the
    middle of its ends.
    """
    first = edges.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min_by(F.struct("osmid", "name"), F.struct("u", "v", "key")).alias("e"))
    c = changes.join(first, ["lo", "hi"], "left").select("cell_id", "lo", "hi", "kind", "direction", R.positive_id(F.col("e.osmid")).alias("osm_id"), R.joined_name(F.col("e.name")).alias("name"))
    a = nodes.select(F.col("node_id").alias("lo"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("hi"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    c = c.join(a, "lo").join(b, "hi")
    filter_ = F.col("kind") == "modal_filter"
    return c.select(
        "cell_id", F.col("lo").alias("u"), F.col("hi").alias("v"), "osm_id", "name", F.col("kind").alias("modification_type"), F.when(F.col("kind") == "one_way", F.coalesce("direction", F.lit("lo_to_hi"))).alias("direction"),
        F.when(filter_, (F.col("x1") + F.col("x2")) / 2).alias("filter_x"), F.when(filter_, (F.col("y1") + F.col("y2")) / 2).alias("filter_y"),
    )


def candidates(scored: DataFrame) -> DataFrame:
    """Rows of ``score`` with what follows from them; traffic_impact is null without inner roads.

    Filters leave residents and emergency services their way; public transport isn't known.
    """
    cut_ = F.least(F.lit(80.0), 0.8 * F.col("traffic"))
    impact = F.struct(F.round(cut_, 1).alias("removed_through_traffic_pct"), F.round(cut_ * 0.3, 1).alias("boundary_load_increase_pct"), F.round(F.col("area_ha") * cut_ * 0.5).alias("estimated_vmt_reduction"), (F.col("interior") * 2).alias("affected_od_pairs"))
    parts = ("size", "shape", "traffic", "access", "density", "edge")
    return scored.select(
        "cell_id", "area_ha", F.round("total", 1).alias("score"), F.struct(*[F.round(p, 1).alias(p) for p in parts], F.round("total", 1).alias("total")).alias("score_breakdown"),
        F.struct(
            F.round("walk_m").alias("max_walking_distance_to_boundary"), F.greatest(F.lit(4), F.floor(F.least("perimeter", F.lit(20)) / 2)).cast("int").alias("delivery_access_points"),
            F.lit(True).alias("emergency_access_maintained"), F.lit(True).alias("residential_access_maintained"), F.lit(False).alias("public_transport_affected"),
        ).alias("accessibility"),
        F.when(F.col("interior") > 0, impact).alias("traffic_impact"),
    )


def serialised(rows: DataFrame) -> DataFrame:
    """(cell_id, json): parts that are null or empty are left out."""
    return rows.select("cell_id", F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "true"}).alias("json"))


#: Ids of a result's perimeter and interior, interventions of a block, and blocks that have them, as results define it.
PERIMETER, INTERIOR, INTERVENTIONS, PLANNED = 30, 50, 100, 20


def road_lists(links: DataFrame, feats: DataFrame) -> DataFrame:
    """(cell_id, perimeter_roads, interior_roads): the smallest ids of each role, as many as a result has."""
    ids = links.join(feats.select("u", "v", "key", "osmid"), ["u", "v", "key"]).select("cell_id", "role", "osmid").distinct()
    of = lambda role, most: F.slice(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("osmid")))), 1, most)
    return ids.groupBy("cell_id").agg(of("boundary", PERIMETER).alias("perimeter_roads"), of("interior", INTERIOR).alias("interior_roads"))


def planned(cells: DataFrame, links: DataFrame, feats: DataFrame, names: DataFrame) -> DataFrame:
    """(cell_id, interventions): what is done to the streets of each block, in the order of their edges (u, v, key).

    names are (u, v, key, name), of which the first one counts.
    """
    what = interventions(cells, links, feats).join(feats.select("u", "v", "key", "osmid"), ["u", "v", "key"]).join(names.select("u", "v", "key", F.get("name", F.lit(0)).alias("name")), ["u", "v", "key"], "left")
    record = F.struct(
        F.col("osmid").alias("osm_id"), "name", F.col("action").alias("intervention_type"), "direction", access_allowed(F.col("action")).alias("access_allowed"), rationale(F.col("action")).alias("rationale"),
    )
    each = F.array_sort(F.collect_list(F.struct("u", "v", "key", record.alias("record"))))
    return what.groupBy("cell_id").agg(F.slice(F.transform(each, lambda x: x["record"]), 1, INTERVENTIONS).alias("interventions"))


def results(best: DataFrame, cells: DataFrame, links: DataFrame, feats: DataFrame, names: DataFrame, geometry: Column) -> DataFrame:
    """(rank, cell_id, json) of ranked rows of ``score`` (with rank from 1): geometry, roads, means, scores, and interventions of the first ones.

    geometry is a column of the cells.  Parts that are empty or null are left out.
    """
    first = best.where(F.col("rank") <= PLANNED).select("cell_id")
    own = lambda df: df.join(best.select("cell_id"), "cell_id", "left_semi")
    plan = planned(cells.join(first, "cell_id", "left_semi"), links.join(first, "cell_id", "left_semi"), feats, names)
    # As many rows as a result has blocks.
    t = candidates(best).join(best.select("cell_id", "rank", "perimeter", "c_edge", "c_inner"), "cell_id")
    t = t.join(road_lists(own(links), feats), "cell_id", "left").join(plan, "cell_id", "left").join(own(cells).select("cell_id", geometry.alias("geometry")), "cell_id")
    full = F.struct(
        F.col("cell_id").cast("string").alias("id"), "geometry", F.round("area_ha", 2).alias("area_hectares"), "perimeter_roads", "interior_roads", "score", F.lit("centrality_based").alias("algorithm"),
        F.col("c_edge").alias("boundary_centrality_mean"), F.col("c_inner").alias("interior_centrality_mean"), F.least("perimeter", F.lit(20)).alias("num_access_points"),
        "score_breakdown", F.expr("if(size(interventions) > 0, interventions, null)").alias("interventions"), "accessibility", "traffic_impact",
    )
    return t.select("rank", "cell_id", F.to_json(full, {"ignoreNullFields": "true"}).alias("json"))
