"""Paths and betweenness by rounds of joins, against the same by one task."""

import random

import pytest

from blockweave.operators import graphs, routing
from tests.test_kernels import random_links


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_same_as_in_tasks(spark, seed):
    links = spark.createDataFrame([*random_links(seed), (50, 51, 2.0)], "lo long, hi long, length double")
    small = {(r[0], r[1]): r[2] for r in graphs.betweenness(links).collect()}
    wide = {(r[0], r[1]): r[2] for r in graphs.betweenness(links, most_links=0).collect()}
    assert wide.keys() == small.keys() and all(wide[e] == pytest.approx(small[e]) for e in small)


def test_routes_same_as_in_tasks(spark):
    turn = random.Random(3)
    arcs = [(a, b, float(turn.randrange(1, 6))) for a in range(9) for b in range(9) if a != b and turn.random() < 0.3] + [(20, 21, 1.0)]
    asked = [(k, turn.randrange(9), turn.randrange(9)) for k in range(12)] + [(90, 0, 21), (91, 4, 4), (92, 21, 20)]
    a, r = spark.createDataFrame(arcs, "u long, v long, cost double"), spark.createDataFrame(asked, "request_id long, origin long, destination long")
    small, wide = ({x["request_id"]: x for x in routing.shortest_paths(a, r, **o).collect()} for o in ({}, {"most_arcs": 0}))
    price = {(u, v): c for u, v, c in arcs}
    assert small.keys() == wide.keys()
    for k, x in small.items():
        assert wide[k]["cost"] == x["cost"] and (wide[k]["path"] is None) == (x["path"] is None)
        if x["path"]:
            p = wide[k]["path"]
            assert (p[0], p[-1]) == (x["path"][0], x["path"][-1]) and sum(price[e] for e in zip(p, p[1:], strict=False)) == x["cost"]
