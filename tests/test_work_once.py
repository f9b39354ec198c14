"""Outlines are traced a batch at a time, and costly columns are worked out once."""

import pytest
from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions import rings
from blockweave.operators import partition, polygonize

SIDES = [(7, 1, 2, 0.0, 0.0), (7, 2, 3, 1.0, 0.0), (7, 3, 1, 1.0, 1.0), (8, 4, 6, 0.0, 0.0), (8, 6, 5, 1.0, 1.0), (8, 5, 4, 1.0, 0.0)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("trace", [polygonize.rings, polygonize.polygons])
def test_outlines_are_traced_in_batches(spark, trace):
    made = trace(spark.createDataFrame(SIDES, "cell_id long, a long, b long, ax double, ay double"), "cell_id").where("ring is not null")
    assert "InPandas" not in plan(made) and plan(made).count("ArrowEvalPython") == 1
    got = {r["cell_id"]: [(p["x"], p["y"]) for p in r["ring"]] for r in made.collect()}
    assert got[7] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert set(got) == ({7, 8} if trace is polygonize.rings else {7})


def test_holes_of_clockwise_sides(spark):
    got = {r["cell_id"]: (r["ring"], len(r["holes"])) for r in polygonize.polygons(spark.createDataFrame(SIDES, "cell_id long, a long, b long, ax double, ay double"), "cell_id").collect()}
    assert got[8] == (None, 1) and got[7][1] == 0


def test_points_of_an_area_are_placed_once():
    assert str(G.utm_hectares(F.col("ring"))._jc).lower().count("atanh") <= 6


def test_centrality_is_read_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def central(k):
        calls.add(1)
        return k / 100.0

    streets = spark.range(100).selectExpr("id as lo", "id + 1 as hi").withColumn("centrality", central.asNondeterministic()("lo"))
    feats = spark.range(100).selectExpr("id as u", "id + 1 as v", "0 as key", "'residential' as highway")
    assert {r["u"] for r in partition.arterials(feats, streets).collect()} == set(range(75, 100))
    assert calls.value == 100


def test_only_streets_of_large_cells_are_asked_for(spark, monkeypatch):
    asked = []
    classify = partition.classify
    monkeypatch.setattr(partition, "classify", lambda placed, chosen, shapes: asked.append((placed, shapes)) or classify(placed, chosen, shapes))
    box = lambda x: [{"x": a, "y": b} for a, b in ((x, 47.0), (x + 0.004, 47.0), (x + 0.004, 47.002), (x, 47.002), (x, 47.0))]
    shapes = spark.createDataFrame([(1, box(19.0), 30.0), (2, box(19.1), 10.0)], f"cell_id long, {polygonize.RING}, area_ha double")
    rows = [(1, 2, 0, "tertiary", 19.002, 47.0, 19.002, 47.002), (3, 4, 0, "residential", 19.001, 47.0, 19.001, 47.002), (5, 6, 0, "primary", 19.0, 47.0, 19.0, 47.002)]
    placed = spark.createDataFrame(rows, "u long, v long, key int, highway string, ux double, uy double, vx double, vy double")
    chosen = spark.createDataFrame([(5, 6, 0)], "u long, v long, key int")
    whole = {tuple(r) for r in classify(placed, chosen, shapes).where("role = 'interior' and cell_id = 1 and u = 1").collect()}
    got = {tuple(r) for r in partition.parting_streets(placed, chosen, shapes, 20.0).where("role = 'interior'").collect()}
    assert got == whole == {(1, 1, 2, 0, "interior")}
    assert [(p.count(), s.count()) for p, s in asked] == [(1, 1)]


def test_meetings_of_pieces_and_sides(spark):
    rows = [(0, 0, 4, 0, 1, -1, 1, 1), (0, 0, 4, 0, 1, 1, 1, 2), (0, 0, 4, 0, -2, 0, 2, 0), (0, 0, 4, 0, 0, 1, 4, 1), (2, 0, 2, 0, 0, 0, 4, 0), (0, 0, 4, 0, 4, 0, 4, 3)]
    names = [f"{s}{c}" for s in "pq" for c in ("x1", "y1", "x2", "y2")]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names)).coalesce(1)
    assert [r[0] for r in df.select(rings.meetings(1e-9)(*names)).collect()] == [[0.25], None, [0.0, 0.5], None, None, [1.0]]


def test_done_faces_leave_the_rounds(spark, monkeypatch):
    n = 40
    # A long ladder: faces of four sides, and an outer ring of 2 * n.
    links = [(k, k + 1) for k in range(n - 1)] + [(100 + k, 101 + k) for k in range(n - 1)] + [(k, 100 + k) for k in range(n)]
    nodes = spark.createDataFrame([(k + 100 * row, float(k), float(row)) for k in range(n) for row in (0, 1)], "node_id long, x double, y double")
    rounds, cut = [], polygonize.cut
    monkeypatch.setattr(polygonize, "cut", lambda df: (lambda out: "done" in out.columns and rounds.append(out.count()) or out)(cut(df)))
    got = polygonize.faces(spark.createDataFrame(links, "lo long, hi long"), nodes).collect()
    assert sorted(r["n_edges"] for r in got) == [4] * (n - 1) + [2 * n]
    assert {tuple(r["nodes"]) for r in got if r["nodes"]} == {(k, k + 1, 100 + k, 101 + k) for k in range(n - 1)}
    assert rounds[0] == 2 * len(links) and 0 < rounds[-1] <= 2 * n
