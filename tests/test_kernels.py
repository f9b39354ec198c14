"""Operators without SQL, against brute force and networks with known answers."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions import roads as R
from blockweave.operators import access, blocks, cell_merge, graphs, network, noding, polygonize, routing, sizing
from blockweave.sources.result_cache import ResultCache
from blockweave.streaming import traffic_stream


def random_links(seed, n=9, m=15):
    r = random.Random(seed)
    pairs = r.sample([(a, b) for a in range(n) for b in range(a + 1, n)], m)
    return [(a, b, float(r.randrange(1, 5))) for a, b in pairs]


def all_paths(links, s, t):
    beside = {}
    for a, b, c in links:
        beside.setdefault(a, []).append((b, c))
        beside.setdefault(b, []).append((a, c))
    best, found = float("inf"), []

    def walk(v, seen, length):
        nonlocal best, found
        if length > best:
            return
        if v == t:
            if length < best:
                best, found = length, []
            found.append(list(seen))
            return
        for w, c in beside.get(v, ()):
            if w not in seen:
                walk(w, [*seen, w], length + c)

    walk(s, [s], 0.0)
    return best, found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_betweenness_same_as_all_paths(spark, seed):
    links = random_links(seed)
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    want = dict.fromkeys([(a, b) for a, b, _ in links], 0.0)
    for s, t in itertools.combinations(nodes, 2):
        _, paths = all_paths(links, s, t)
        for p in paths:
            for a, b in zip(p, p[1:], strict=False):
                want[min(a, b), max(a, b)] += 1 / len(paths)
    pairs = len(nodes) * (len(nodes) - 1) / 2
    got = {(r[0], r[1]): r[2] for r in graphs.betweenness(spark.createDataFrame(links, "lo long, hi long, length double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k] / pairs) < 1e-9 for k in want)


def test_betweenness_of_a_path(spark):
    got = graphs.betweenness(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "lo long, hi long, length double"))
    assert [round(r[0] * 6) for r in got.orderBy("lo").select("centrality").collect()] == [3, 4, 3]
    # A network above the size for one task has a result, too.
    one = graphs.betweenness(spark.createDataFrame([(0, 1, 1.0)], "lo long, hi long, length double"), most_links=0)
    assert [tuple(r) for r in one.collect()] == [(0, 1, 1.0)]


def test_sources_of_betweenness_grow_with_the_network():
    assert [graphs.analysis_pivots(n) for n in (3, 2499, 2500, 6000, 20_000)] == [None, None, 250, 600, 800]


def test_betweenness_asks_for_sources_by_nodes(spark):
    links = spark.createDataFrame([(k, k + 1, 1.0) for k in range(300)], "lo long, hi long, length double")
    got = {r[0]: r[2] for r in graphs.betweenness(links, graphs.analysis_pivots).collect()}
    assert all(abs(got[k] - (k + 1) * (300 - k) / (301 * 150)) < 1e-9 for k in range(300))


@pytest.mark.parametrize("seed", range(6))
def test_min_cut_same_as_all_subsets(seed):
    links = random_links(seed, 6, 9)
    sources, sinks = {0, 1}, {4, 5}

    def parted(gone):
        seen, todo = set(sources), list(sources)
        while todo:
            v = todo.pop()
            for a, b, _ in links:
                if (a, b) not in gone and v in (a, b):
                    w = b if v == a else a
                    if w not in seen:
                        seen.add(w)
                        todo.append(w)
        return not seen & sinks

    cost = {(a, b): c for a, b, c in links}
    least = min(sum(cost[e] for e in gone) for k in range(10) for gone in itertools.combinations(cost, k) if parted(set(gone)))
    value, cut = blocks.min_cut(links, sources, sinks)
    assert value == least == sum(cost[e] for e in cut) and parted(set(cut))


def test_routes_are_shortest(spark):
    links = random_links(8, 10, 18)
    arcs = spark.createDataFrame(links + [(b, a, c) for a, b, c in links] + [(50, 51, 1.0)], "u long, v long, cost double")
    pairs = list(itertools.product(range(10), range(10))) + [(0, 51)]
    requests = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "request_id long, origin long, destination long")
    for r in routing.shortest_paths(arcs, requests).collect():
        best, _ = all_paths(links, *pairs[r["request_id"]])
        assert (r["cost"] is None and best == float("inf")) or abs(r["cost"] - best) < 1e-9


def test_segments_break_where_the_class_changes(spark):
    steps = spark.createDataFrame([(1, k, k, k + 1, 100.0, h) for k, h in enumerate(["primary", "primary", "service", "primary"])], "request_id long, k int, u long, v long, length double, highway string")
    segs = routing.segments(steps)
    assert [(r["highway"], r["steps"]) for r in segs.orderBy("segment").collect()] == [("primary", 2), ("service", 1), ("primary", 1)]
    t = routing.route_totals(segs).first()
    assert (t["km"], t["arterial_percent"]) == (0.4, 75.0)


def faces_of(spark, points, links):
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "node_id long, x double, y double")
    return [r for r in polygonize.faces(spark.createDataFrame(links, "lo long, hi long"), nodes).collect() if r["area2"] > 0]


def test_faces_of_known_networks(spark):
    grid = [(x, y) for y in range(3) for x in range(3)]
    lines = [(a, b) for a in range(9) for b in range(a + 1, 9) if abs(grid[a][0] - grid[b][0]) + abs(grid[a][1] - grid[b][1]) == 1]
    assert [r["area2"] for r in faces_of(spark, grid, lines)] == [2.0] * 4
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (2, 2), (3, 3), (4, 2)]
    around = [(0, 1), (1, 2), (2, 3), (0, 3)]
    assert len(faces_of(spark, square, around + [(2, 4)])) == 1
    two = faces_of(spark, square, around + [(2, 4), (4, 5), (5, 6), (4, 6)])
    assert sorted(r["n_edges"] for r in two) == [3, 4]


def test_components_and_hops(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 91)], "lo long, hi long")
    assert {tuple(r) for r in graphs.components(links).collect()} == {(k, 0) for k in range(31)} | {(90, 90), (91, 90)}
    arcs = links.toDF("u", "v")
    assert graphs.hops(arcs, spark.createDataFrame([(0,)], "node long"), 5).count() == 6
    labels = graphs.components(links)
    assert network.largest_component(labels).count() == 31


def test_oddly_typed_attributes(spark):
    rows = [(["2;3"], [None], ["a", "", "a", "b"], [-1, 5]), ([None], ["50 mph"], [None], []), (["3"], ["walk"], None, None)]
    df = spark.createDataFrame(rows, "lanes array<string>, speed array<string>, name array<string>, ids array<long>")
    got = df.select(R.lanes(F.col("lanes")), R.maxspeed(F.col("speed")), R.joined_name(F.col("name")), R.positive_id(F.col("ids"))).collect()
    assert [tuple(r) for r in got] == [(1, None, "a / b", 5), (1, 50, None, 0), (3, None, None, 0)]


def test_geometry(spark):
    ring = "array(struct(19D as x, 47.5D as y), struct(19.01D as x, 47.5D as y), struct(19.01D as x, 47.51D as y), struct(19D as x, 47.51D as y), struct(19D as x, 47.5D as y))"
    row = spark.sql(f"select {ring} as ring").select(
        G.mercator_hectares(F.col("ring")).alias("m"), G.utm_hectares(F.col("ring")).alias("u"), G.contains(F.col("ring"), F.lit(19.005), F.lit(47.505)).alias("i"), G.contains(F.col("ring"), F.lit(19.02), F.lit(47.505)).alias("o"),
        G.roundness(F.col("ring")).alias("q"), G.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"), G.axis_angle(F.lit(-1.0), F.lit(-1.0)).alias("a"), F.size(G.circle(F.lit(0.0), F.lit(0.0), 100.0)).alias("c"),
    ).first()
    assert abs(row["m"] * 0.45625 / row["u"] - 1) < 0.005 and row["i"] and not row["o"]
    assert abs(row["q"] - 0.785398) < 1e-5 and abs(row["h"] - 111194.9) < 0.5 and row["a"] == 45.0 and row["c"] == 65


def test_sizes(spark):
    assert [r[0] for r in spark.createDataFrame([(3.0,), (12.0,), (25.0,), (40.0,)], "ha double").select(sizing.sector_count(F.col("ha"))).collect()] == [3, 4, 6, 8]


def test_cache(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "c"))
    nested = {"features": [{"type": "Feature", "geometry": {"coordinates": [[1.5, 2.5]]}}], "n": None}
    assert cache.get("network", {"a": 1}) is None
    assert cache.set("network", {"a": 1, "b": 2}, nested) and cache.get("network", {"b": 2, "a": 1}) == nested
    cache.set("network", {"a": 2}, [1], ttl=1)
    cache.set("search", {"q": "x"}, "y", ttl=0)
    time.sleep(1.2)
    assert cache.get("network", {"a": 2}) is None and cache.get("search", {"q": "x"}) == "y"
    assert cache.cleanup() == 1 and cache.hit_rate() == 0.5
    assert cache.invalidate("network", {"none": 0}) == 1
    assert cache.invalidate("network") == 1 and cache.invalidate() == 1
    off = ResultCache(spark, str(tmp_path / "off"), enabled=False)
    assert off.set("network", {}, 1) is False and off.get("network", {}) is None


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {tuple(r) for r in traffic_stream.hourly_counts(events).collect()}
    stream = traffic_stream.read_events(spark, "/root/testdata/sf0.001", events.schema)
    got = traffic_stream.run_to_table(traffic_stream.hourly_counts(stream), "hourly")
    assert {tuple(r) for r in got.collect()} == batch and batch


def test_crossings_same_as_all_pairs(spark):
    r = random.Random(3)
    segs = [(k, r.random(), r.random(), r.random(), r.random()) for k in range(40)]
    want = {k: 0 for k in range(40)}
    for (i, ax, ay, bx, by), (j, cx, cy, dx, dy) in itertools.combinations(segs, 2):
        side = lambda px, py, qx, qy, x, y: (qx - px) * (y - py) - (qy - py) * (x - px)
        if side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0 and side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0:
            want[i] += 1
            want[j] += 1
    got = noding.split_at_crossings(spark.createDataFrame(segs, "seg_id long, x1 double, y1 double, x2 double, y2 double"), 0.1).groupBy("seg_id").count().collect()
    assert {r["seg_id"]: r["count"] - 1 for r in got} == want


def test_thin_lines(spark):
    line = [(float(k), 0.00001 * (k % 2)) for k in range(50)] + [(50.0, 5.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in line],), (None,)], "line array<struct<x:double,y:double>>")
    got = [r[0] for r in df.select(noding.simplify()(F.col("line"))).collect()]
    assert len(got[0]) == 3 and got[1] is None


def test_merging_keeps_the_whole(spark):
    areas = spark.createDataFrame([(k, 4.0 + k % 3) for k in range(20)], "cell_id long, ha double")
    beside = spark.createDataFrame([(k, k + 1) for k in range(19)], "a long, b long")
    rows = cell_merge.merge_small(areas, beside, least=7.0, most=16.0, target=12.0).collect()
    merged = {r["merged_id"]: r["ha"] for r in rows}
    assert len(rows) == 20 and abs(sum(merged.values()) - sum(4.0 + k % 3 for k in range(20))) < 1e-9
    assert max(merged.values()) <= 16 and len(merged) < 12
    for r in rows:
        members = [x["cell_id"] for x in rows if x["merged_id"] == r["merged_id"]]
        assert members == list(range(min(members), max(members) + 1)) or sorted(members) == list(range(min(members), max(members) + 1))


def test_merging_ends_only_when_no_pair_is_left(spark):
    # Areas change steadily over the grid, so each cell prefers the same side.
    n, least, most = 24, 10.0, 20.0
    areas = spark.createDataFrame([(x * n + y, 7.0 + (x * n + y) / 1024) for x in range(n) for y in range(n)], "cell_id long, ha double")
    pairs = [(x * n + y, (x + i) * n + y + j) for x in range(n) for y in range(n) for i, j in ((0, 1), (1, 0)) if x + i < n and y + j < n]
    rows = cell_merge.merge_small(areas, spark.createDataFrame(pairs, "a long, b long"), least=least, most=most, target=16.0).collect()
    ha, merged = {r["merged_id"]: r["ha"] for r in rows}, {r["cell_id"]: r["merged_id"] for r in rows}
    assert len(rows) == n * n and abs(sum(ha.values()) - sum(7.0 + k / 1024 for k in range(n * n))) < 1e-6
    for a, b in pairs:
        x, y = merged[a], merged[b]
        assert x == y or min(ha[x], ha[y]) >= least or ha[x] + ha[y] > most


def test_one_way_direction_keeps_sectors_apart(spark):
    # Door 0 (sector 0) - 1 - 2 - 3 door (sector 1); a spur 1 - 4 - 5 hangs on the first half.
    pairs = [(0, 1), (1, 2), (2, 3), (1, 4), (4, 5)]
    links = spark.createDataFrame([(7, a, b, 0, "interior") for x, y in pairs for a, b in ((x, y), (y, x))], "cell_id long, u long, v long, key int, role string")
    sectors = spark.createDataFrame([(7, 0, 0), (7, 3, 1)], "cell_id long, node_id long, sector int")
    changes = spark.createDataFrame([(7, 1, 2)], "cell_id long, lo long, hi long")
    row = access.one_way_directions(links, sectors, changes).first()
    # Either way one door reaches the other; from 3 more nodes are reached against the arrow of lo to hi.
    arcs = {0: {1}, 1: {0, 4}, 2: {1, 3}, 3: {2}, 4: {1, 5}, 5: {4}}
    assert (row["direction"], row["score"]) == ("hi_to_lo", access.direction_score(arcs, {0: 0, 3: 1}))
    assert access.direction_score({0: {1}}, {0: 0, 3: 1}) == 1
