"""SQL of the queries of single operators and of the city's cells, for DuckDB over the same tables."""

from __future__ import annotations

from blockweave.plans.oracle import BASE, ORACLE_SQL

PLAN = ", plan AS (SELECT lo, hi, CASE WHEN lo % 7 = 0 THEN 'modal_filter' ELSE 'one_way' END AS kind FROM simple WHERE lo % 7 = 0 OR lo % 11 = 0)"
NAMES = ", nm AS (SELECT *, CASE s % 3 WHEN 0 THEN ['Street ' || least(u, v), '', 'Street ' || least(u, v), 'Ring'] WHEN 1 THEN ['Street ' || least(u, v)] END AS name FROM e)"
LINES = """, ln AS (SELECT u, v, key, CASE WHEN s % 4 = 0 AND key = 0 AND u < v THEN 3 ELSE 2 END AS points, ux, uy, vx, vy FROM ends)"""
ENTRIES = """, x AS (SELECT cell_id, role, unnest([u, v]) AS node_id FROM links),
en AS (SELECT cell_id, node_id FROM x GROUP BY 1, 2 HAVING count(*) FILTER (role = 'boundary') > 0 AND count(*) FILTER (role = 'interior') > 0)"""
INNER = (
    PLAN
    + """, il AS (SELECT DISTINCT cell_id, least(u, v) AS lo, greatest(u, v) AS hi FROM links WHERE role = 'interior'),
op AS (SELECT cell_id, lo, hi FROM il ANTI JOIN plan USING (lo, hi)),
ar AS (SELECT cell_id, lo AS a, hi AS b FROM op UNION ALL SELECT cell_id, hi, lo FROM op),
cl AS (SELECT DISTINCT cell_id, a, a AS b FROM ar UNION SELECT cl.cell_id, cl.a, ar.b FROM cl JOIN ar ON ar.cell_id = cl.cell_id AND ar.a = cl.b),
ic AS (SELECT cell_id, a AS node_id, min(b) AS label FROM cl GROUP BY 1, 2)"""
)
RECURSIVE = BASE.replace("WITH ", "WITH RECURSIVE ", 1)

VIEWS_SQL = {
    "street_names": BASE + NAMES + " SELECT u, v, key, nullif(array_to_string(CASE s % 3 WHEN 0 THEN ['Street ' || least(u, v), 'Ring'] WHEN 1 THEN name ELSE [] END, ' / '), '') AS joined, name[1] AS first FROM nm",
    "box_checks": BASE + ", b AS (SELECT address_id, 2 * ((address_id % 9) - 1) / 16.0::DOUBLE AS span FROM addr) SELECT address_id, CASE WHEN span > 0.5 THEN 'too large' WHEN span <= 0 THEN 'inverted' END AS reason FROM b",
    "box_keys": BASE + "SELECT address_id, printf('%.5f_%.5f_%.5f_%.5f', round(y + 0.01::DOUBLE, 5), round(y - 0.01::DOUBLE, 5), round(x + 0.01::DOUBLE, 5), round(x - 0.01::DOUBLE, 5)) AS box_key FROM addr",
    "address_first_box": BASE + """, bx AS (SELECT k AS box_id, 19.0::DOUBLE + k * gw / 8192.0::DOUBLE AS w, 19.0::DOUBLE + (k + 4) * gw / 8192.0::DOUBLE AS e, 47.5::DOUBLE + gw * 5 / 8192.0::DOUBLE AS n FROM g, (SELECT unnest([0, 2, 4, 6])::BIGINT AS k))
SELECT address_id AS request_id, min(box_id) AS box_id FROM addr JOIN bx ON x >= w AND x + 1 / 1024.0::DOUBLE <= e AND y BETWEEN 47.5 AND n GROUP BY 1""",
    "edge_lines": BASE + LINES + " SELECT u, v, key, points, CASE WHEN points = 3 THEN (ux + vx) / 2 + 1 / 16384.0::DOUBLE ELSE vx END AS x, CASE WHEN points = 3 THEN (uy + vy) / 2 ELSE vy END AS y FROM ln",
    "edge_arrows": BASE + LINES + ", k AS (SELECT unnest([0, 1, 2]) AS k) SELECT u, v, key, k, CAST(floor((points - 1) * (k + 1) * 0.25) AS INTEGER) AS place FROM ln, k",
    "road_styles": BASE + """SELECT u, v, key, CASE hierarchy WHEN 2 THEN '220,20,60,255' WHEN 3 THEN '255,69,0,255' WHEN 4 THEN '255,140,0,255' WHEN 5 THEN '255,215,0,255' WHEN 6 THEN '144,238,144,255' WHEN 7 THEN '152,251,152,255' WHEN 8 THEN '176,196,222,255' WHEN 9 THEN '211,211,211,255' ELSE '128,128,128,200' END AS colour,
  CAST(CASE hierarchy WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 2.5 WHEN 6 THEN 2 WHEN 7 THEN 1.5 WHEN 8 THEN 1.5 WHEN 9 THEN 1 ELSE 1.5 END AS DOUBLE) AS width FROM f""",
    "coupled_limits": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS low_moved_low, greatest(p_size + 2.0::DOUBLE, 25) AS low_moved_high, least(CAST(p_size AS DOUBLE), 24) AS high_moved_low, 25.0::DOUBLE AS high_moved_high FROM part",
    "cell_status": BASE + "SELECT cell_id, CASE WHEN cell_id % 3 <> 0 AND cell_id % 8 <> 0 THEN 'green' WHEN cell_id % 3 <> 0 THEN 'yellow' ELSE 'red' END AS status FROM cells",
    "entry_labels": BASE + ENTRIES + " SELECT cell_id, node_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY node_id) - 1 AS INTEGER) AS ordinal, substr(sha256(cell_id || '_' || node_id), 1, 8) AS id FROM en",
    "flagged_edges": BASE + "SELECT u, v, key, least(u, v) % 7 = 0 AS vehicle_blocked FROM e",
    "open_edges": BASE + "SELECT u, v, key FROM e WHERE least(u, v) % 7 <> 0",
    "changed_streets": BASE + PLAN + ", ids AS (SELECT DISTINCT osmid, kind FROM e JOIN plan ON lo = least(u, v) AND hi = greatest(u, v)) SELECT u, v, key, osmid, kind FROM e JOIN ids USING (osmid)",
    "last_changes": "SELECT user_id * 4 AS osmid, arg_max(event_type, (ts, event_id)) AS last_kind, arg_min(event_type, (ts, event_id)) AS first_kind FROM events GROUP BY 1",
    "cell_touching_edges": BASE + """, m AS (SELECT d.*, (ux + vx) / 2 AS mx, (uy + vy) / 2 AS my FROM ends d),
pe AS (SELECT cell_id, u, v, key, osmid FROM cells c JOIN m ON (ux IN (x0, x1) AND uy BETWEEN y0 AND y1) OR (uy IN (y0, y1) AND ux BETWEEN x0 AND x1) OR (vx IN (x0, x1) AND vy BETWEEN y0 AND y1) OR (vy IN (y0, y1) AND vx BETWEEN x0 AND x1)),
ii AS (SELECT cell_id, u, v, key, osmid FROM cells c JOIN m ON mx > x0 AND mx < x1 AND my > y0 AND my < y1)
SELECT cell_id, u, v, key, 'perimeter' AS role FROM pe UNION ALL SELECT cell_id, u, v, key, 'interior' FROM ii WHERE (cell_id, osmid) NOT IN (SELECT (cell_id, osmid) FROM pe)""",
    "cell_boundary_ids": BASE + ", k AS (SELECT l.cell_id, unnest(CASE WHEN e.s % 13 = 0 THEN [e.osmid, e.osmid + 1000000] ELSE [e.osmid] END) AS id FROM links l JOIN e USING (u, v, key) WHERE l.role = 'boundary') SELECT cell_id, list_sort(list(DISTINCT id)) AS boundary_roads FROM k WHERE id > 0 GROUP BY 1",
    "cell_entries_near": BASE + ENTRIES + " SELECT cell_id, node_id FROM en",
    "address_nearest_entry": BASE + ENTRIES + ", n AS (SELECT DISTINCT node_id, nodes2.x, nodes2.y FROM en JOIN nodes2 USING (node_id)) SELECT address_id, arg_min(node_id, ((n.x - a.x) * (n.x - a.x) + (n.y - a.y) * (n.y - a.y), node_id)) AS node_id FROM addr a, n GROUP BY 1",
    "address_reverse": BASE + ", p AS (SELECT CAST(n_nationkey AS BIGINT) AS place_id, 40.0::DOUBLE + n_nationkey / 4.0::DOUBLE AS lat, 10.0::DOUBLE + n_nationkey / 8.0::DOUBLE AS lon FROM nation) SELECT address_id, arg_min(place_id, ((lon - x) * (lon - x) + (lat - y) * (lat - y), place_id)) AS place_id FROM addr, p GROUP BY 1",
    "intervention_counts": "SELECT cell_id, " + ", ".join(f"count(*) FILTER (action = '{k}') AS {k}" for k in ("no_change", "one_way", "pedestrianize", "modal_filter", "local_access")) + " FROM (" + ORACLE_SQL["cell_interventions"] + ") GROUP BY 1",
    "intervention_access": "SELECT action, count(*) AS n, CASE action WHEN 'no_change' THEN 'all' WHEN 'pedestrianize' THEN 'emergency, delivery_hours' WHEN 'modal_filter' THEN 'bicycle, emergency' ELSE 'residents, delivery, emergency' END AS allowed FROM (" + ORACLE_SQL["cell_interventions"] + ") GROUP BY 1",
    "inner_components": RECURSIVE + INNER + " SELECT cell_id, node_id, label FROM ic",
    "component_counts": RECURSIVE + INNER + " SELECT cell_id, count(DISTINCT label) AS areas, count(*) AS nodes FROM ic GROUP BY 1",
    "inner_subgraph": BASE + ", k AS (SELECT node_id FROM nodes WHERE cx % 2 = cy % 2 OR cx % 3 = 0) SELECT u, v, key FROM e WHERE u IN (SELECT node_id FROM k) AND v IN (SELECT node_id FROM k)",
    "event_type_runs": "WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, event_type FROM l WHERE p IS NULL OR p <> event_type",
    "cell_change_kinds": BASE + PLAN + ", k AS (SELECT DISTINCT cell_id, kind FROM links JOIN plan ON lo = least(u, v) AND hi = greatest(u, v)) SELECT cell_id, string_agg(kind, ', ' ORDER BY kind) AS kinds FROM k GROUP BY 1",
    "address_circles": BASE + "SELECT address_id, 65 AS points, round(x + greatest(100.0::DOUBLE / 111320, 100.0::DOUBLE / (111320 * cos(radians(y)))), 9) AS x, round(y, 9) AS y FROM addr",
    "row_lines_thinned": BASE + "SELECT cy, CAST(count(*) AS INTEGER) AS before, CAST(least(2, count(*)) AS INTEGER) AS after, min(x) AS x0, max(x) AS x1 FROM nodes2 GROUP BY cy",
    "cell_feature_texts": BASE + "SELECT cell_id, 5 AS points, 'Feature' AS type, x1 AS x FROM cells",
    "edge_kinds_of_network": BASE + ", k AS (SELECT unnest(['drive', 'bike', 'walk', 'all']) AS kind), c AS (SELECT count(*) AS n FROM e) SELECT kind, n FROM k, c",
    "network_source": BASE + ", w AS (SELECT 19.0::DOUBLE + (gw - 1) / 2048.0::DOUBLE AS m FROM g) SELECT u, v, key, length FROM ends, w WHERE ux <= m OR vx <= m",
    "city_cells": BASE + """, ext AS (SELECT max(cx) AS mx, max(cy) AS my FROM nodes),
ry AS (SELECT DISTINCT cy AS y FROM nodes, ext WHERE cy % 4 = 0 OR cy = my),
st2 AS (SELECT y AS y0, lead(y) OVER (ORDER BY y) AS y1 FROM ry),
cxl AS (SELECT DISTINCT cx AS c FROM nodes, ext WHERE cx % 4 = 0 OR cx = mx),
vl AS (SELECT y0, y1, c FROM st2, cxl, ext, g WHERE y1 IS NOT NULL AND (c = 0 OR c = mx OR y1 * gw + c < n)),
rc AS (SELECT y0, y1, c AS c0, lead(c) OVER (PARTITION BY y0 ORDER BY c) AS c1 FROM vl),
xy AS (SELECT 19.0::DOUBLE + c0 / 1024.0::DOUBLE AS x0, 19.0::DOUBLE + c1 / 1024.0::DOUBLE AS x1, 47.5::DOUBLE + y0 * 5.0::DOUBLE / 8192.0::DOUBLE AS y0, 47.5::DOUBLE + y1 * 5.0::DOUBLE / 8192.0::DOUBLE AS y1 FROM rc WHERE c1 IS NOT NULL)
SELECT round(x0, 7) AS x0, round(y0, 7) AS y0, round(x1, 7) AS x1, round(y1, 7) AS y1 FROM xy WHERE (x1 - x0) * (y1 - y0) * 111320 * 111320 * cos(radians((y0 + y1) / 2)) / 10000 BETWEEN 0.5 AND 100""",
    "cell_violations": RECURSIVE + INNER.replace("ANTI JOIN plan USING (lo, hi)", "") + ENTRIES.replace(", x AS", ", x9 AS").replace("FROM x GROUP", "FROM x9 GROUP") + """,
an AS (SELECT en.cell_id, en.node_id, atan2(n.y - (c.y0 + c.y1) / 2, n.x - (c.x0 + c.x1) / 2) + pi() / 4 AS a FROM en JOIN cells c USING (cell_id) JOIN nodes2 n USING (node_id)),
se AS (SELECT cell_id, node_id, least(CAST(floor((a - 2 * pi() * floor(a / (2 * pi()))) / (pi() / 2)) AS INTEGER), 3) AS sector FROM an),
dr AS (SELECT cell_id, label, sector, count(*) AS n FROM se JOIN ic USING (cell_id, node_id) GROUP BY 1, 2, 3)
SELECT p.cell_id, p.sector AS sector_a, q.sector AS sector_b, CAST(sum(p.n * q.n) AS BIGINT) AS pairs FROM dr p JOIN dr q ON p.cell_id = q.cell_id AND p.label = q.label AND p.sector < q.sector GROUP BY 1, 2, 3""",
}

#: Least costs from the origins of all requests, and the nodes of each request's path, the smallest predecessor of equals.
ROUTES = """, h AS (SELECT a.address_id, n.node_id, (n.x - a.x) * (n.x - a.x) + (n.y - a.y) * (n.y - a.y) AS d2 FROM addr a JOIN nodes2 n ON abs(n.x - a.x) <= 0.005 AND abs(n.y - a.y) <= 0.005),
nn AS (SELECT address_id, arg_min(node_id, (d2, node_id)) AS node_id FROM h GROUP BY 1),
rq AS (SELECT p.address_id AS request_id, p.node_id AS o, q.node_id AS d FROM nn p JOIN nn q ON q.address_id = p.address_id + 1 WHERE p.address_id % 2 = 0),
pr AS (SELECT u, v, min(length * CASE WHEN highway IN ('primary', 'secondary', 'tertiary') THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END) AS c FROM e WHERE {where} GROUP BY 1, 2),
og AS (SELECT DISTINCT o FROM rq),
r(o, node, cost) USING KEY (o, node) AS (SELECT o, o, 0.0::DOUBLE FROM og
  UNION SELECT r.o, pr.v, min(r.cost + pr.c) FROM r JOIN pr ON pr.u = r.node LEFT JOIN recurring.r AS q ON q.o = r.o AND q.node = pr.v WHERE q.cost IS NULL OR q.cost > r.cost + pr.c GROUP BY r.o, pr.v),
rm AS MATERIALIZED (SELECT o, node, cost FROM r),
nr AS MATERIALIZED (SELECT rm.o, rm.node, rm.cost FROM rm JOIN (SELECT rq.o, max(rm.cost) AS far FROM rq JOIN rm ON rm.o = rq.o AND rm.node = rq.d GROUP BY 1) m ON m.o = rm.o AND rm.cost <= m.far),
bf AS MATERIALIZED (SELECT p.o, pr.v AS node, min(p.node) AS came FROM nr p JOIN pr ON pr.u = p.node JOIN nr x ON x.o = p.o AND x.node = pr.v AND x.cost = p.cost + pr.c WHERE x.node <> x.o GROUP BY 1, 2),
pa(request_id, o, node, back) AS (SELECT request_id, rq.o, d, 0 FROM rq JOIN rm ON rm.o = rq.o AND rm.node = rq.d UNION ALL SELECT request_id, pa.o, came, back + 1 FROM pa JOIN bf ON bf.o = pa.o AND bf.node = pa.node)
"""
FREE = RECURSIVE + ROUTES.format(where="true")
SEGMENTS = (
    FREE
    + """, sp AS (SELECT request_id, lead(node) OVER w AS u, node AS v, back FROM pa WINDOW w AS (PARTITION BY request_id ORDER BY back)),
be AS (SELECT u, v, arg_min(length, (length, key)) AS length, arg_min(highway, (length, key)) AS highway FROM e GROUP BY 1, 2),
sg AS (SELECT request_id, -back AS k, length, highway FROM sp JOIN be USING (u, v)),
mk AS (SELECT *, CASE WHEN highway = lag(highway) OVER (PARTITION BY request_id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM sg),
nu AS (SELECT *, sum(fresh) OVER (PARTITION BY request_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM mk),
seg AS (SELECT request_id, CAST(segment AS BIGINT) AS segment, highway, count(*) AS steps, sum(length) AS length FROM nu GROUP BY 1, 2, 3)
"""
)
VIEWS_SQL |= {
    "components": RECURSIVE + """, ar AS (SELECT lo AS a, hi AS b FROM simple UNION ALL SELECT hi, lo FROM simple),
r(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM ar UNION SELECT ar.b, min(r.label) FROM r JOIN ar ON ar.a = r.node JOIN recurring.r AS q ON q.node = ar.b WHERE r.label < q.label GROUP BY ar.b)
SELECT node, label FROM r""",
    "entry_reach": RECURSIVE + ENTRIES + """, de AS (SELECT DISTINCT u, v FROM e),
r(node, hops) USING KEY (node) AS (SELECT DISTINCT node_id, 0 FROM en UNION SELECT de.v, min(r.hops) + 1 FROM r JOIN de ON de.u = r.node LEFT JOIN recurring.r AS q ON q.node = de.v WHERE q.node IS NULL GROUP BY de.v)
SELECT node, hops FROM r""",
    "routes_after_changes": RECURSIVE + ROUTES.format(where="least(u, v) % 7 <> 0 AND NOT (least(u, v) % 11 = 0 AND u > v)") + "SELECT request_id, cost FROM rq LEFT JOIN rm ON rm.o = rq.o AND rm.node = rq.d",
    "route_costs": FREE + ", le AS (SELECT request_id, CAST(count(*) AS INTEGER) AS n_nodes FROM pa GROUP BY 1) SELECT request_id, cost, n_nodes FROM rq LEFT JOIN rm ON rm.o = rq.o AND rm.node = rq.d LEFT JOIN le USING (request_id)",
    "route_segments": SEGMENTS + "SELECT request_id, segment, highway, steps, length FROM seg",
    "route_summary": SEGMENTS + """, su AS (SELECT request_id, sum(length) AS m, sum(length * CASE WHEN highway IN ('primary', 'secondary', 'tertiary') THEN 5 WHEN highway = 'residential' THEN 8 ELSE 10 END) AS slow, sum(CASE WHEN highway IN ('primary', 'secondary', 'tertiary') THEN length ELSE 0.0::DOUBLE END) AS a FROM seg GROUP BY 1)
SELECT request_id, floor(m + 0.5::DOUBLE) / 1000 AS km, floor(slow * 60 / 200 + 0.5::DOUBLE) / 1000 AS minutes, CASE WHEN m > 0 THEN floor(1000 * a / m + 0.5::DOUBLE) / 10 ELSE 100.0::DOUBLE END AS arterial_percent FROM su""",
    "route_changes": SEGMENTS.replace(", seg AS", ", seg0 AS") + PLAN + """, st3 AS (SELECT request_id, kind FROM sp JOIN plan ON lo = least(u, v) AND hi = greatest(u, v))
SELECT request_id, count(*) AS streets, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM st3 GROUP BY 1""",
    "size_recommendation": BASE + """, tt AS (SELECT sum(length) AS total, sum(CASE WHEN uy = vy THEN length ELSE 0 END) AS flat FROM ends), kk AS (SELECT count(*) AS n FROM nodes),
bb AS (SELECT total / greatest(1.0::DOUBLE, n / 4.0::DOUBLE) / 4 AS block, CASE WHEN flat >= total - flat THEN 2.5::DOUBLE ELSE 92.5::DOUBLE END AS o FROM tt, kk),
ss AS (SELECT 300.0::DOUBLE AS min_side, least(CASE WHEN block * 3.5 BETWEEN 300 AND 500 THEN block * 3.5 ELSE 400.0::DOUBLE END, 420.0::DOUBLE) AS side, 500.0::DOUBLE AS max_side, o * 0.9::DOUBLE + 0.1::DOUBLE * 15 AS orientation FROM bb)
SELECT min_side, side, max_side, orientation, 1.0::DOUBLE AS regularity, min_side * min_side / 10000 AS min_ha, side * side / 10000 AS ha, max_side * max_side / 10000 AS max_ha FROM ss""",
}
#: Entries by sector, without a plan.
_SECTORS = VIEWS_SQL["cell_violations"].split("\ndr AS")[0].rstrip().rstrip(",")
VIEWS_SQL["cell_violation_paths"] = (
    _SECTORS
    + """, ds(cell_id, sector, node, hops) USING KEY (cell_id, sector, node) AS (SELECT DISTINCT se.cell_id, sector, node_id, 0 FROM se
  UNION SELECT ds.cell_id, ds.sector, ar.b, min(ds.hops) + 1 FROM ds JOIN ar ON ar.cell_id = ds.cell_id AND ar.a = ds.node LEFT JOIN recurring.ds AS q ON q.cell_id = ds.cell_id AND q.sector = ds.sector AND q.node = ar.b WHERE q.node IS NULL GROUP BY ds.cell_id, ds.sector, ar.b),
dm AS MATERIALIZED (SELECT * FROM ds), nd AS (SELECT DISTINCT cell_id, a AS node FROM ar),
fd AS (SELECT dm.cell_id, dm.sector AS sa, se.sector AS sb, arg_min(dm.node, (hops, dm.node)) AS node, min(hops) AS hops FROM dm JOIN se ON se.cell_id = dm.cell_id AND se.node_id = dm.node WHERE se.sector > dm.sector GROUP BY 1, 2, 3),
pv AS MATERIALIZED (SELECT x.cell_id, x.sector, x.node, min(y.node) AS came FROM dm x JOIN ar ON ar.cell_id = x.cell_id AND ar.b = x.node JOIN dm y ON y.cell_id = x.cell_id AND y.sector = x.sector AND y.node = ar.a AND y.hops = x.hops - 1 GROUP BY 1, 2, 3),
wk(cell_id, sa, sb, hops, node, far, path) AS (SELECT cell_id, sa, sb, hops, node, hops, CAST(node AS VARCHAR) FROM fd
  UNION ALL SELECT wk.cell_id, sa, sb, wk.hops, came, far - 1, came || ',' || path FROM wk JOIN pv ON pv.cell_id = wk.cell_id AND pv.sector = wk.sa AND pv.node = wk.node WHERE far > 0)
SELECT cell_id, sa AS sector_a, sb AS sector_b, hops AS streets, path FROM wk WHERE far = 0"""
)
VIEWS_SQL["cell_directed_violations"] = (
    _SECTORS
    + """, dw AS MATERIALIZED (SELECT DISTINCT cell_id, u AS a, v AS b FROM links WHERE role = 'interior'),
dr(cell_id, sector, node) AS (SELECT DISTINCT cell_id, sector, node_id FROM se UNION SELECT dr.cell_id, dr.sector, dw.b FROM dr JOIN dw ON dw.cell_id = dr.cell_id AND dw.a = dr.node)
SELECT dr.cell_id, dr.sector AS sector_from, se.sector AS sector_to, count(*) AS entries FROM dr JOIN se ON se.cell_id = dr.cell_id AND se.node_id = dr.node WHERE se.sector <> dr.sector GROUP BY 1, 2, 3"""
)
