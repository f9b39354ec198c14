from random import Random

from pyspark.sql import functions as F

from blockweave.functions import geometry as G
from blockweave.functions import rings
from blockweave.operators import lines

SCHEMA = "ring array<struct<x:double,y:double>>, x double, y double"


def test_batches_give_what_expressions_give(spark):
    """Rings of all sizes, a ring without a side, none, and points on corners and without coordinates."""
    r, rows = Random(3), []
    for k in range(400):
        corners = [(r.randrange(8) / 4, r.randrange(8) / 4) for _ in range(r.randrange(1, 9))]
        ring = None if k % 50 == 7 else corners + corners[:1] if k % 50 else corners[:1]
        rows.append((ring, r.randrange(32) / 16, r.randrange(32) / 16) if k % 3 else (ring, *corners[0]))
    rows += [([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], None, 0.5)]
    ring, x, y = F.col("ring"), F.col("x"), F.col("y")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = df.select(G.contains(ring, x, y), rings.contains(ring, x, y), G.boundary_distance(ring, x, y), rings.boundary_distance(ring, x, y)).collect()
    assert len(out) == len(rows)
    for inside, batch_inside, far, batch_far in out:
        assert bool(inside) == bool(batch_inside) and far == batch_far
    spots = F.array(F.struct("x", "y"), F.struct((x + 1).alias("x"), y.alias("y")))
    made = df.where("x is not null and size(ring) > 1").select("ring", spots.alias("spots"), rings.places(1e-9)(ring, spots).alias("got"))
    on = lambda s: G.boundary_distance(ring, s["x"], s["y"]) <= 1e-9
    want = F.transform("spots", lambda s: F.when(on(s), 0).when(G.contains(ring, s["x"], s["y"]), 1).otherwise(2))
    assert all(a == b for a, b in made.select("got", want).collect())


def test_lines_meet_rings_in_batches(spark):
    """Neither the boxes of rings nor distances from them are left to be computed row by row in one plan with the pairs of pieces and sides."""
    point = "struct<x:double,y:double>"
    line = spark.createDataFrame([(1, [(0.5, 0.5), (3.0, 0.5)])], f"street_id long, geom array<{point}>")
    shape = spark.createDataFrame([(7, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])], f"cell_id long, ring array<{point}>")
    out = lines.relations(line, shape, ["street_id"], size=0.5)
    assert "array_min" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.asDict() for r in out.collect()] == [{"street_id": 1, "cell_id": 7, "meets": True, "inside": True, "outside": True, "on": False, "holds": False}]
