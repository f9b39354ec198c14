"""The whole result of the analysis, against the rules of its parts."""

import json

from blockweave.functions import roads as R
from blockweave.operators import blocks
from blockweave.plans import city
from blockweave.plans.all import QUERIES

SF = "/root/testdata/sf0.001"


def test_whole_result(spark, monkeypatch):
    made = city._candidates(spark, SF)
    scored, roles, shapes = made
    monkeypatch.setattr(city, "_candidates", lambda *_: made)
    rows = QUERIES["analysis_result"](spark, SF).collect()
    by = {p: [json.loads(r.json) for r in sorted(rows, key=lambda r: r["rank"]) if r.part == p] for p in ("analysis_params", "network_stats", "candidate")}
    assert by["analysis_params"] == [{"min_area_hectares": 4, "max_area_hectares": 25, "centrality_threshold_percentile": 70}]
    assert by["network_stats"][0]["total_nodes"] == 200
    score = {r.cell_id: r for r in scored.collect()}
    found = by["candidate"]
    assert [int(x["id"]) for x in found] == sorted(score, key=lambda c: (-round(score[c].total + 1e-9, 1), c))[:50]
    feats = {(r.u, r.v, r.key): r for r in QUERIES["network_features"](spark, SF).collect()}
    names = {(r.u, r.v, r.key): r.name for r in city.S.edges(spark, SF).select("u", "v", "key", "name").collect()}
    at = {r.node_id: (r.x, r.y) for r in city.S.nodes(spark, SF).collect()}
    ring = {r.cell_id: [(p.x, p.y) for p in r.ring] for r in shapes.collect()}
    of = {}
    for r in roles.collect():
        of.setdefault(str(r.cell_id), []).append(r)
    rank = R.RANK | R.EXTRA_RANK["analysis"]
    for n, x in enumerate(found, 1):
        own, pts = of[x["id"]], ring[int(x["id"])]
        ids = {k: sorted({feats[r.u, r.v, r.key].osmid for r in own if r.role == k}) for k in ("boundary", "interior")}
        assert x["perimeter_roads"] == ids["boundary"][:30] and x["interior_roads"] == ids["interior"][:50]
        shape = x["geometry"]
        assert x["accessibility"]["max_walking_distance_to_boundary"] == round(score[int(x["id"])].walk_m) and shape["type"] == "Polygon" and [tuple(p) for p in shape["coordinates"][0]] == pts
        assert x["num_access_points"] == min(20, len(ids["boundary"])) and x["boundary_centrality_mean"] == score[int(x["id"])].c_edge
        if n > 20:
            assert "interventions" not in x
            continue
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:], strict=False)) / 2
        o = pts[0]
        mx, my = (o[k] + sum((a[k] + b[k] - 2 * o[k]) * ((a[0] - o[0]) * (b[1] - o[1]) - (b[0] - o[0]) * (a[1] - o[1])) for a, b in zip(pts, pts[1:], strict=False)) / (6 * area) for k in (0, 1))
        want = []
        for r in sorted(own, key=lambda r: (r.u, r.v, r.key))[:100]:
            f = feats[r.u, r.v, r.key]
            (a, b), (c, d) = at[r.u], at[r.v]
            far = (((a + c) / 2 - mx) ** 2 + ((b + d) / 2 - my) ** 2) ** 0.5 / area**0.5
            what = "no_change" if r.role == "boundary" else "one_way" if rank.get(f.highway, 99) <= 5 else "pedestrianize" if far < 0.3 else "modal_filter" if rank.get(f.highway, 99) >= 7 else "local_access"
            one = {"osm_id": f.osmid, "intervention_type": what, "access_allowed": blocks.ACCESS[what], "rationale": blocks.RATIONALE[what]}
            if names[r.u, r.v, r.key]:
                one["name"] = names[r.u, r.v, r.key][0]
            if what == "one_way":
                one["direction"] = "forward" if f.osmid % 2 == 0 else "backward"
            want.append(one)
        assert x["interventions"] == want
    assert len(found) >= 5
