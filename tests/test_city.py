"""City partition, access diagnosis, block routes and their parts, on small networks."""

import random

import numpy as np
import pandas as pd
import pytest

from blockweave.functions import geometry as G
from blockweave.functions.lineage import cut
from blockweave.operators import access, display, network, noding, partition, polygonize, routing, spatial
from blockweave.sources.network import of_kind
from blockweave.sources.partition_store import PartitionStore
from blockweave.sources.settings import Settings
from blockweave.streaming import traffic_stream


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def shapes(spark, *rings):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rings, 1)], f"cell_id long, {polygonize.RING}")


@pytest.mark.parametrize("seed,spread", [(1, 0.01), (2, 1.0), (3, 170.0)])
def test_nearest_same_as_brute_force_also_far_away(spark, seed, spread):
    r = random.Random(seed)
    nodes = [(k, 19 + r.uniform(-spread, spread) / 9, 47 + r.uniform(-spread, spread) / 20) for k in range(60)] + [(99, 19.0, 47.0), (98, 19.0, 47.0)]
    points = [(k, 19 + r.uniform(-spread, spread), 47 + r.uniform(-spread, spread) / 4) for k in range(40)] + [(900, 19.0, 47.0), (901, 170.0, -80.0), (902, None, 1.0)]
    got = spatial.nearest(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(nodes, "node_id long, x double, y double"), "p").collect()
    want = {p: min(((x - nx) ** 2 + (y - ny) ** 2, n) for n, nx, ny in nodes)[1] for p, x, y in points if x is not None}
    assert {r["p"]: r["node_id"] for r in got} == want


def test_nearest_without_nodes(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0)], "p long, x double, y double")
    assert [r["node_id"] for r in spatial.nearest(points, spark.createDataFrame([], "node_id long, x double, y double"), "p").collect()] == [None]


@pytest.mark.parametrize("seed", range(3))
def test_index_percentile_same_as_sorting(spark, seed):
    r = random.Random(seed)
    values = [r.choice([r.random(), 0.5, 0.25]) for _ in range(97)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for percent in (0, 33, 70, 99):
        row = network.index_percentile(df, "v", percent).first()
        assert (row["value"], row["n"]) == (sorted(values)[97 * percent // 100], 97)
    assert tuple(network.index_percentile(df.where("v > 2"), "v", 70).first()) == (None, None)


def test_long_event_is_whole(spark):
    e = spark.createDataFrame([("progress", "x", 1, "m" * 1_500_000)], "type string, stage string, percent int, message string")
    assert len(display.parse_events(display.event_text(e)).first()["message"]) == 1_500_000


def test_parallel_segments_meet_at_each_others_ends(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.004, 0.0), (2, 0.001, 0.0, 0.002, 0.0), (3, 0.003, 0.001, 0.003, 0.0)], "seg_id long, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r[0], round(r[1], 9)) for r in noding.crossings(s).collect()) == [(1, 0.25), (1, 0.5), (1, 0.75)]


def test_loops_and_outlines():
    assert polygonize.loops([(1, 2), (2, 3), (3, 1)]) == [[1, 2, 3, 1]]
    eight = polygonize.loops([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 1)])
    assert sorted(sorted(w[:-1]) for w in eight) == [[1, 2, 3], [1, 4, 5]]


def test_merged_outline_of_neighbours_with_other_corners(spark):
    a, b, c = ring((0, 0), (1, 0), (1, 2), (0, 2)), ring((1, 0), (2, 0), (2, 1), (1, 1)), ring((1, 1), (2, 1), (2, 2), (1, 2))
    small = [[{k: v / 256 for k, v in p.items()} for p in r] for r in (a, b, c)]
    s = shapes(spark, *small)
    pieces = partition.sides(s)
    assert sorted(map(tuple, partition.beside(pieces).collect())) == [(1, 2), (1, 3), (2, 3)]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "cell_id long, merged_id long")
    rows = partition.merged(s, pieces, labels).select("cell_id", G.signed_area(partition.F.col("ring")).alias("a")).collect()
    assert {r["cell_id"]: round(abs(r["a"]) * 65536, 6) for r in rows} == {1: 3.0, 3: 1.0}


def grid(spark, n, step=1 / 1024):
    nodes = [(j * n + i, 19 + i * step, 47.5 + j * step) for j in range(n) for i in range(n)]
    kind = lambda i: "primary" if i in (0, n - 1) else "residential"
    edges = []
    for j in range(n):
        for i in range(n):
            v = j * n + i
            for w, ok, h in ((v + 1, i + 1 < n, kind(j)), (v + n, j + 1 < n, kind(i))):
                if ok:
                    edges += [(v, w, 0, [v + 1], [h], None, "no", None, 70.0, None), (w, v, 0, [v + 1], [h], None, "no", None, 70.0, None)]
    e = spark.createDataFrame(edges, "u long, v long, key int, osmid array<long>, highway array<string>, lanes array<string>, oneway string, maxspeed array<string>, length double, name array<string>")
    return cut(e), cut(spark.createDataFrame(nodes, "node_id long, x double, y double"))


def test_partition_of_one_block(spark):
    edges, nodes = grid(spark, 6)
    feats = network.features(edges)
    placed, box = network.with_points(feats, nodes), (19.0, 47.5, 19 + 5 / 1024, 47.5 + 5 / 1024)
    chosen = partition.arterials(feats)
    made = partition.cells(placed, chosen, box)
    assert made.count() == 1
    links = partition.classify(placed, chosen, made)
    assert {r["role"]: r["n"] for r in links.groupBy("role").agg(partition.F.count("*").alias("n")).collect()} == {"boundary": 40, "interior": 80}
    sectors, changes, lost = partition.enforced(made, links, feats, nodes)
    assert sectors.count() == 16 and changes.count() > 0
    table = partition.block_table(made, links, edges, sectors, changes, lost)
    row = table.first()
    assert row["validated"] and row["modal_filters"] == changes.count() and row["entries"] == 16
    totals = partition.totals(table, box).first()
    assert totals["blocks"] == 1 and totals["coverage_percent"] == pytest.approx(100, abs=0.5)


def test_large_cells_are_split_and_nothing_is_lost(spark):
    edges, nodes = grid(spark, 8)
    middle = edges.withColumn("highway", partition.F.expr("case when u % 8 = 3 and v % 8 = 3 then array('trunk') else highway end"))
    feats = network.features(middle)
    placed, box = network.with_points(feats, nodes), (19.0, 47.5, 19 + 7 / 1024, 47.5 + 7 / 1024)
    chosen = partition.arterials(feats)
    made = partition.cells(placed, chosen, box)
    out = partition.sized(made, placed, chosen, least=3.0, most=20.0, target=12.0)
    areas = sorted(r["area_ha"] for r in out.collect())
    assert len(areas) == 2 and areas[0] / areas[1] == pytest.approx(3 / 4, abs=0.01)
    assert sum(areas) == pytest.approx(made.first()["area_ha"], rel=1e-6)


def cell(spark):
    """Entries 1 and 5 on a path 1-2-3-4-5 with a dead end 3-6, and an isolated pair 8-9."""
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (3, 6), (8, 9)]
    rows = [(7, a, b, 0, "interior") for a, b in pairs] + [(7, b, a, 0, "interior") for a, b in pairs]
    links = spark.createDataFrame(rows, "cell_id long, u long, v long, key int, role string")
    sectors = spark.createDataFrame([(7, 1, 0), (7, 5, 2)], "cell_id long, node_id long, sector int")
    changes = spark.createDataFrame([(7, 2, 3, "modal_filter", 1.0), (7, 3, 4, "modal_filter", 1.0)], "cell_id long, lo long, hi long, kind string, cost double")
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in (1, 2, 3, 4, 5, 6, 8, 9)], "node_id long, x double, y double")
    return links, sectors, changes, nodes


def test_diagnosis_and_advice(spark):
    links, sectors, changes, nodes = cell(spark)
    lost = cut(access.unreachable(links, sectors, changes))
    assert sorted(r["node_id"] for r in lost.collect()) == [3, 6, 8, 9]
    why = {r["node_id"]: (r["nearest_sector"], r["reason"]) for r in access.diagnose(links, sectors, changes, lost, nodes).collect()}
    assert why == {3: (0, "Blocked by modifications: modal_filter"), 6: (2, "Blocked by modifications: modal_filter"), 8: (2, "Node was already isolated in original graph"), 9: (2, "Node was already isolated in original graph")}
    row = access.suggest(links, sectors, changes, lost).first()
    assert (row["areas"], row["lost"], row["worst_lo"], row["worst_hi"], row["opens"]) == (2, 4, 2, 3, 2)
    assert row["advice"] == ["2 disconnected areas found. Review superblock boundary placement."]
    none = access.suggest(links, sectors, changes, lost.limit(0))
    assert none.count() == 0


def test_block_routes_on_a_ring_of_arterials(spark):
    edges, nodes = grid(spark, 6)
    step = 1 / 1024
    block = shapes(spark, ring((19, 47.5), (19 + 5 * step, 47.5), (19 + 5 * step, 47.5 + 5 * step), (19, 47.5 + 5 * step)))
    placed = network.with_points(network.features(edges), nodes)
    doors = spatial.cell_entries(spatial.cell_edges(placed, block))
    at = lambda i, j: (19 + (i + 0.1) * step, 47.5 + (j + 0.1) * step)
    trips = [(1, *at(1, 1), *at(3, 2)), (2, *at(1, 1), *at(1, 1)), (3, 19 - step, 47.5 - step, 19 + 6 * step, 47.5 + 6 * step), (4, *at(1, 1), 19 + 6 * step, 47.5 + 6 * step)]
    r = {x["request_id"]: x for x in routing.block_routes(spark.createDataFrame(trips, "request_id long, ox double, oy double, dx double, dy double"), edges, nodes, block, doors).collect()}
    assert all(x["success"] for x in r.values())
    assert r[1]["cost"] == 3 * 70 * 1.5 and r[1]["blocks"] == [1] and r[2]["cost"] == 0 and r[2]["blocks"] == []
    assert r[3]["cost"] == 10 * 70 and r[3]["blocks"] == []
    # One street to the nearest entry (1 on the lower side), then the arterials.
    assert r[4]["cost"] == 70 * 1.5 + 9 * 70 and r[4]["path"][0] == 7 and r[4]["path"][-1] == 35
    cut_off = edges.where("u <> 35 and v <> 35")
    bad = routing.block_routes(spark.createDataFrame(trips[3:], "request_id long, ox double, oy double, dx double, dy double"), cut_off, nodes, block, doors).first()
    assert not bad["success"] and bad["reason"] == routing.REASONS["arterial"]


def test_kinds_of_network(spark):
    e = spark.createDataFrame([(k, [h]) for k, h in enumerate(["motorway", "footway", "residential", "path"])] + [(9, None)], "u long, highway array<string>")
    assert {k: sorted(r["u"] for r in of_kind(e, k).collect()) for k in ("drive", "walk", "bike", "all")} == {"drive": [0, 2, 9], "walk": [1, 2, 3, 9], "bike": [2, 3, 9], "all": [0, 1, 2, 3, 9]}


def test_settings_and_store(spark, tmp_path):
    assert Settings.from_environment({}) == Settings()
    s = Settings.from_environment({"BLOCKWEAVE_DEBUG": "Yes", "BLOCKWEAVE_CACHE_TTL_SECONDS": "5", "BLOCKWEAVE_CACHE_DIR": "x"})
    assert (s.debug, s.cache_ttl_seconds, s.cache_dir) == (True, 5, "x")
    store, box = PartitionStore(spark, str(tmp_path)), (19.0, 47.5, 19.1, 47.6)
    assert store.get(box) is None
    store.put(box, spark.range(3))
    store.put(box, spark.range(2))
    assert store.get(box).count() == 2 and store.get((19.0, 47.5, 19.1, 47.7)) is None


def test_progress_and_running_load(spark, tmp_path):
    events = list(traffic_stream.progress([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: None)]))
    assert [(e["type"], e["stage"], e["percent"]) for e in events] == [("progress", "a", 0), ("progress", "b", 33), ("error", "b", 33)]
    assert list(traffic_stream.progress([("a", lambda: None)]))[-1]["type"] == "complete"
    rows = spark.createDataFrame(pd.DataFrame({"user_id": [1, 1, 2], "event_id": [1, 2, 3]}), "user_id long, event_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = traffic_stream.running_load(stream).writeStream.outputMode("update").format("memory").queryName("loads").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["osmid"], r["vehicles"]) for r in spark.table("loads").collect()} == {(4, 74), (8, 37)}


def test_utm_of_a_known_place(spark):
    """A tower whose UTM place is published: zone 17, 630084 m east (500000 of them false) and 4833438 m north; mirrored south of the equator."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[G.utm_point(F.struct(F.lit(-79.387139).alias("x"), F.lit(s * 43.642567).alias("y")), F.lit(-81.0)).alias(n) for n, s in (("north", 1), ("south", -1))]).first()
    assert (row["north"].x + 500000, row["north"].y) == pytest.approx((630084, 4833438), abs=2)
    assert (row["south"].x, row["south"].y) == pytest.approx((row["north"].x, -row["north"].y), abs=1e-6)
