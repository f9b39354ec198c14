"""SQL of the queries over the town."""

from __future__ import annotations

from blockweave.plans.oracle import BASE, RANK

# The town by arithmetic over part, spelt out anew so that nothing is shared with the library.
TOWN = """
WITH RECURSIVE g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS gw, count(*) AS np FROM part),
jn AS (SELECT p_partkey AS p, p_partkey % gw AS cx, CAST(floor(p_partkey / CAST(gw AS DOUBLE)) AS BIGINT) AS cy, CAST(p_size AS BIGINT) AS s, p_type AS kind FROM part, g),
jp AS (SELECT *, 19.0::DOUBLE + cx / 1024.0::DOUBLE + (p * 37 % 5 - 2) / 16384.0::DOUBLE AS x, 47.5::DOUBLE + cy * 5.0::DOUBLE / 8192.0::DOUBLE + (p * 53 % 5 - 2) / 16384.0::DOUBLE AS y FROM jn),
bs AS (SELECT a.*, 0 AS axis, a.p + 1 AS q, a.cy AS line FROM jp a, g WHERE a.cx + 1 < gw AND a.p + 1 < np UNION ALL SELECT a.*, 1, a.p + gw, a.cx FROM jp a, g WHERE a.p + gw < np),
bh AS (SELECT *, CASE WHEN line % 16 = 0 THEN 'primary' WHEN line % 8 = 0 THEN 'secondary' WHEN line % 4 = 0 THEN 'tertiary' WHEN s IN (41, 42) THEN 'footway' WHEN s = 43 THEN 'path' WHEN s = 44 THEN 'cycleway' WHEN s = 45 THEN 'pedestrian' WHEN s = 46 THEN 'steps' WHEN s = 49 THEN 'motorway'
  WHEN s = 50 THEN 'trunk' WHEN kind = 'ECONOMY' THEN 'living_street' WHEN kind = 'SMALL' THEN 'service' WHEN kind = 'PROMO' THEN 'unclassified' ELSE 'residential' END AS highway,
  1 + s % 5 AS n, (CASE WHEN axis = 0 THEN 73.25::DOUBLE ELSE 68.0::DOUBLE END) + s * 0.25::DOUBLE AS whole FROM bs
  WHERE NOT (axis = 1 AND cy % 14 = 11) AND NOT (axis = 1 AND cy % 7 = 4 AND cx <> 0) AND NOT (axis = 0 AND s % 11 = 10)),
pc AS (SELECT *, unnest(range(0, n)) AS k FROM bh),
lp AS (SELECT p, x, y, p % 97 = 0 AS alone, unnest([0, 1, 2]) AS k FROM jp WHERE p % 97 < 2),
fw AS (SELECT CASE WHEN k = 0 THEN p * 16 ELSE p * 16 + axis * 5 + k END AS u, CASE WHEN k + 1 = n THEN q * 16 ELSE p * 16 + axis * 5 + k + 1 END AS v, p * 4 + axis * 2 AS osmid, highway, s % 10 = 0 AS oneway, floor(whole * 64 / n) / 64 + k / 64.0::DOUBLE AS length FROM pc
  UNION ALL SELECT p * 16, q * 16, p * 4 + axis * 2 + 1, highway, true, whole + 5 FROM bh WHERE s % 25 = 7
  UNION ALL SELECT CASE WHEN NOT alone AND k = 0 THEN p * 16 ELSE p * 16 + 11 + k END, CASE WHEN NOT alone AND k = 2 THEN p * 16 ELSE p * 16 + 11 + (k + 1) % 3 END, p + 5000000000, 'residential', NOT alone, 20 + k / 8.0::DOUBLE FROM lp),
te AS (SELECT * FROM fw UNION ALL SELECT v, u, osmid, highway, oneway, length FROM fw WHERE NOT oneway),
tn AS (SELECT p * 16 AS node, x, y FROM jp
  UNION ALL SELECT p * 16 + axis * 5 + k, pc.x + (z.x - pc.x) * k / n + k * (n - k) * (pc.s % 3 - 1) / 65536.0::DOUBLE, pc.y + (z.y - pc.y) * k / n + k * (n - k) * (pc.s % 3 - 1) / 65536.0::DOUBLE FROM pc JOIN (SELECT p AS q, x, y FROM jp) z USING (q) WHERE k > 0
  UNION ALL SELECT p * 16 + 11 + k, x + (1 + k) / 32768.0::DOUBLE, y + (1 + k % 2) / 32768.0::DOUBLE FROM lp WHERE alone OR k > 0)
"""
LARGEST = TOWN + """, dr AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM te WHERE highway NOT IN ('footway', 'path', 'cycleway', 'pedestrian', 'steps')),
ar AS (SELECT u AS a, v AS b FROM dr UNION SELECT v, u FROM dr),
r(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM ar UNION SELECT ar.b, min(r.label) FROM r JOIN ar ON ar.a = r.node JOIN recurring.r AS q ON q.node = ar.b WHERE r.label < q.label GROUP BY ar.b),
lb AS MATERIALIZED (SELECT node, label FROM r), big AS (SELECT label FROM lb GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1),
so AS MATERIALIZED (SELECT dr.* FROM dr JOIN lb ON lb.node = dr.u JOIN big USING (label))
"""
# A node of two neighbours with one way through, or one each way, is passed through; a walk from each edge that leaves another node.
WALKS = LARGEST + """, nb AS (SELECT u AS node, v AS o, 0 AS i FROM so UNION ALL SELECT v, u, 1 FROM so),
ct AS (SELECT node, list_sort(list(o) FILTER (i = 1)) AS src, list_sort(list(o) FILTER (i = 0)) AS dst FROM nb GROUP BY 1),
th AS MATERIALIZED (SELECT node FROM ct WHERE (len(src) = 1 AND len(dst) = 1 AND src[1] <> dst[1] OR len(src) = 2 AND src = dst AND src[1] <> src[2]) AND NOT list_contains(src, node) AND NOT list_contains(dst, node)),
wk AS (SELECT id AS first, 1 AS place, u AS start, v AS after, id, u, v FROM so WHERE u NOT IN (SELECT node FROM th)
  UNION ALL SELECT wk.first, place + 1, start, after, so.id, so.u, so.v FROM wk JOIN th ON th.node = wk.v JOIN so ON so.u = wk.v AND so.v <> wk.u),
ch AS (SELECT first, any_value(start) AS u, arg_max(wk.v, place) AS v, any_value(after) AS after, count(*) AS n_pieces, sum(length) AS length, list(osmid ORDER BY place) AS ids, list(highway ORDER BY place) AS ways, bool_or(oneway) AS oneway FROM wk JOIN so USING (id) GROUP BY first)
"""
DISTINCT = "array_to_string(list_transform(list_filter({0}, lambda x, i: list_position({0}, x) = i), lambda x: CAST(x AS VARCHAR)), ',')"

TOWN_SQL = {
    "town_kinds": TOWN + """SELECT 'drive' AS kind, count(*) AS n, sum(length) AS metres FROM te WHERE highway NOT IN ('footway', 'path', 'cycleway', 'pedestrian', 'steps')
UNION ALL SELECT 'bike', count(*), sum(length) FROM te WHERE highway NOT IN ('motorway', 'footway', 'steps') UNION ALL SELECT 'walk', count(*), sum(length) FROM te WHERE highway <> 'motorway' UNION ALL SELECT 'all', count(*), sum(length) FROM te""",
    "town_source": LARGEST + "SELECT u, v, 0 AS key, length FROM so",
    "town_simplified": WALKS + "SELECT ch.u, ch.v, CAST(row_number() OVER (PARTITION BY ch.u, ch.v ORDER BY after) - 1 AS INTEGER) AS key, CAST(n_pieces AS INTEGER) AS n_pieces, ch.length, " + DISTINCT.format("ids") + " AS osmids, " + DISTINCT.format("ways") + """ AS highways,
  CASE WHEN so.oneway THEN 'yes' ELSE 'no' END AS oneway, CAST(n_pieces + 1 AS INTEGER) AS points, round(tn.x, 9) AS x1, round(tn.y, 9) AS y1 FROM ch JOIN tn ON tn.node = after JOIN so ON so.id = ch.first""",
    "town_directions": TOWN + """, an AS (SELECT length, degrees(atan2(b.y - a.y, b.x - a.x)) AS d FROM te JOIN tn a ON a.node = te.u JOIN tn b ON b.node = te.v)
SELECT least(35, CAST(floor((d - 180 * floor(d / 180)) / 5) AS INTEGER)) AS bin, sum(length) AS length FROM an GROUP BY 1""",
    "town_size_recommendation": TOWN + """, an AS (SELECT length, degrees(atan2(b.y - a.y, b.x - a.x)) AS d FROM te JOIN tn a ON a.node = te.u JOIN tn b ON b.node = te.v),
ag AS (SELECT length, d - 180 * floor(d / 180) AS d FROM an), hs AS (SELECT least(35, CAST(floor(d / 5) AS INTEGER)) AS bin, sum(length) AS length FROM ag GROUP BY 1),
tp AS (SELECT arg_max(bin, (length, -bin)) * 5 + 2.5::DOUBLE AS o FROM hs),
aw AS (SELECT length, o, least(abs(d - o), 180 - abs(d - o)) AS away FROM ag, tp),
rg AS (SELECT any_value(o) AS o, sum(CASE WHEN away <= 15 OR abs(away - 90) <= 15 THEN length ELSE 0 END) / sum(length) AS regularity, sum(length) / greatest(1.0::DOUBLE, (SELECT count(*) FROM tn) / 4.0::DOUBLE) / 4 AS block FROM aw),
lm AS (SELECT *, CASE WHEN regularity < 0.5 THEN 240.0::DOUBLE ELSE 300.0::DOUBLE END AS lo, CASE WHEN regularity < 0.5 THEN 600.0::DOUBLE ELSE 500.0::DOUBLE END AS hi FROM rg),
rs AS (SELECT lo AS min_side, least(CASE WHEN block * 3.5 BETWEEN lo AND hi THEN block * 3.5 ELSE 400.0::DOUBLE END, 420.0::DOUBLE) AS side, least(hi, 504.0::DOUBLE) AS max_side, o * 0.9::DOUBLE + 1.5::DOUBLE AS orientation, regularity FROM lm)
SELECT *, min_side * min_side / 10000 AS min_ha, side * side / 10000 AS ha, max_side * max_side / 10000 AS max_ha FROM rs""",
    # Pieces are clipped to the rectangle of a cell: the range of places along them that lie in all four half-planes.
    "town_streets_in_cells": TOWN + """, pt AS (SELECT p * 2 + axis AS street_id, k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pc
  JOIN tn a ON a.node = CASE WHEN k = 0 THEN p * 16 ELSE p * 16 + axis * 5 + k END JOIN tn b ON b.node = CASE WHEN k + 1 = n THEN q * 16 ELSE p * 16 + axis * 5 + k + 1 END),
cl AS (SELECT a.p AS cell_id, 19.0::DOUBLE + a.cx / 1024.0::DOUBLE AS x0, 47.5::DOUBLE + a.cy * 5.0::DOUBLE / 8192.0::DOUBLE AS y0, 19.0::DOUBLE + b.cx / 1024.0::DOUBLE AS x9, 47.5::DOUBLE + b.cy * 5.0::DOUBLE / 8192.0::DOUBLE AS y9
  FROM jn a JOIN jn b ON b.cx = a.cx + 4 AND b.cy = a.cy + 4 WHERE a.cx % 4 = 0 AND a.cy % 4 = 0),
nr AS (SELECT DISTINCT street_id, cell_id FROM pt JOIN cl ON greatest(x1, x2) >= x0 AND least(x1, x2) <= x9 AND greatest(y1, y2) >= y0 AND least(y1, y2) <= y9),
cp AS (SELECT nr.street_id, nr.cell_id, x1, y1, x2, y2, x0, y0, x9, y9, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len,
  CASE WHEN x1 = x2 THEN CASE WHEN x1 BETWEEN x0 AND x9 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END ELSE least((x0 - x1) / (x2 - x1), (x9 - x1) / (x2 - x1)) END AS xa, CASE WHEN x1 = x2 THEN 1.0::DOUBLE ELSE greatest((x0 - x1) / (x2 - x1), (x9 - x1) / (x2 - x1)) END AS xb,
  CASE WHEN y1 = y2 THEN CASE WHEN y1 BETWEEN y0 AND y9 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END ELSE least((y0 - y1) / (y2 - y1), (y9 - y1) / (y2 - y1)) END AS ya, CASE WHEN y1 = y2 THEN 1.0::DOUBLE ELSE greatest((y0 - y1) / (y2 - y1), (y9 - y1) / (y2 - y1)) END AS yb
  FROM nr JOIN cl USING (cell_id) JOIN pt USING (street_id)),
ct AS (SELECT *, greatest(xa, ya, 0.0::DOUBLE) AS ta, least(xb, yb, 1.0::DOUBLE) AS tb FROM cp),
cf AS (SELECT *, x1 > x0 AND x1 < x9 AND y1 > y0 AND y1 < y9 AND x2 > x0 AND x2 < x9 AND y2 > y0 AND y2 < y9 AS deep, x1 + (ta + tb) / 2 * (x2 - x1) AS mx, y1 + (ta + tb) / 2 * (y2 - y1) AS my FROM ct),
rl AS (SELECT street_id, cell_id, bool_or(ta <= tb AND NOT deep) AS meets, bool_or(ta < tb AND mx > x0 AND mx < x9 AND my > y0 AND my < y9) AS inside, bool_or(NOT (ta = 0 AND tb = 1)) AS outside,
  sum(len * (x1 + x2) / 2) / sum(len) AS gx, sum(len * (y1 + y2) / 2) / sum(len) AS gy, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x9) AS x9, any_value(y9) AS y9 FROM cf GROUP BY 1, 2)
SELECT street_id, cell_id, meets, inside AND NOT outside AS within, inside AND outside AS crosses, CASE WHEN meets THEN 'perimeter' WHEN gx > x0 AND gx < x9 AND gy > y0 AND gy < y9 THEN 'interior' END AS role FROM rl WHERE meets OR inside""",
    "ring_reasons": TOWN + """SELECT CASE a.p % 6 WHEN 1 THEN 'crossing' WHEN 2 THEN 'repeated' WHEN 3 THEN 'spike' WHEN 5 THEN 'spike' ELSE 'valid' END AS reason, count(*) AS rings
FROM jp a, g WHERE a.cx + 1 < gw AND a.p + gw + 1 < np GROUP BY 1""",
    # Corners from the first one on; the diagonals' place of a bow tie by Cramer's rule, of its two lobes the larger one.
    "ring_repairs": TOWN + """, qd AS (SELECT a.p, b.x - a.x AS bx, b.y - a.y AS by_, c.x - a.x AS cx, c.y - a.y AS cy, d.x - a.x AS dx, d.y - a.y AS dy FROM jp a, g, jp b, jp c, jp d WHERE a.cx + 1 < gw AND b.p = a.p + 1 AND c.p = a.p + gw + 1 AND d.p = a.p + gw AND a.p % 6 <> 5),
cr AS (SELECT *, (bx * (dy - by_) - by_ * (dx - bx)) / (cx * (dy - by_) - cy * (dx - bx)) AS t FROM qd),
ar AS (SELECT p, bx * cy - cx * by_ + cx * dy - dx * cy AS whole, bx * (t * cy) - (t * cx) * by_ AS lower, (cx - dx) * (t * cy - dy) - (t * cx - dx) * (cy - dy) AS upper FROM cr)
SELECT p AS cell_id, 1 AS parts, round(CASE WHEN p % 6 = 1 THEN greatest(abs(lower), abs(upper)) ELSE abs(whole) END, 9) AS area2 FROM ar""",
    "town_arrows": TOWN + """, pz AS (SELECT p * 2 + axis AS street_id, n, k, node, tn.x, tn.y FROM (SELECT p, q, axis, n, k, CASE WHEN k = 0 THEN p * 16 WHEN k = n THEN q * 16 ELSE p * 16 + axis * 5 + k END AS node FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM bh)) JOIN tn USING (node)),
aw AS (SELECT DISTINCT street_id, n, m AS k, CAST(floor(n * (m + 1) * 0.25::DOUBLE) AS INTEGER) AS place FROM pz, (SELECT unnest([0, 1, 2]) AS m))
SELECT aw.street_id, aw.k, aw.place, round(o.x, 9) AS x, round(o.y, 9) AS y, round(degrees(atan2(b.y - a.y, b.x - a.x)), 6) AS angle FROM aw JOIN pz o ON o.street_id = aw.street_id AND o.k = place
JOIN pz a ON a.street_id = aw.street_id AND a.k = greatest(0, place - 1) JOIN pz b ON b.street_id = aw.street_id AND b.k = least(aw.n, place + 1)""",
    "street_colours": BASE + """, c1 AS (SELECT min(cell_id) AS cell_id FROM cells), lk AS (SELECT l.*, """ + RANK + """ AS hier, sqrt(pow((ux + vx) / 2 - (x0 + x1) / 2, 2) + pow((uy + vy) / 2 - (y0 + y1) / 2, 2)) / sqrt((x1 - x0) * (y1 - y0)) AS far FROM links l JOIN cells USING (cell_id) JOIN c1 USING (cell_id)),
an AS (SELECT u, v, key, role, CASE WHEN role = 'boundary' THEN NULL WHEN hier <= 5 THEN '59,130,246,255' WHEN far < 0.3 THEN '34,197,94,255' WHEN hier >= 7 THEN '251,191,36,255' END AS tint FROM lk),
st2 AS (SELECT hierarchy, CASE hierarchy WHEN 2 THEN '220,20,60,255' WHEN 3 THEN '255,69,0,255' WHEN 4 THEN '255,140,0,255' WHEN 5 THEN '255,215,0,255' WHEN 6 THEN '144,238,144,255' WHEN 7 THEN '152,251,152,255' WHEN 8 THEN '176,196,222,255' WHEN 9 THEN '211,211,211,255' END AS style FROM (SELECT DISTINCT hierarchy FROM f)),
al AS (SELECT ti.*, style, tint, role FROM ti JOIN st2 USING (hierarchy) LEFT JOIN an USING (u, v, key)),
md AS (SELECT u, 'traffic' AS mode, least(255, CAST(floor(intensity / 100.0::DOUBLE * 255) AS BIGINT)) || ',' || least(255, CAST(floor((1 - intensity / 100.0::DOUBLE) * 200) AS BIGINT)) || ',50,220' AS colour FROM al
  UNION ALL SELECT u, 'interventions', CASE WHEN tint IS NOT NULL THEN tint WHEN role = 'boundary' THEN '156,163,175,200' WHEN role = 'interior' THEN '100,100,100,180' ELSE '200,200,200,100' END FROM al
  UNION ALL SELECT u, 'partition', CASE WHEN least(u, v) % 14 = 0 THEN '124,58,237,255' WHEN least(u, v) % 7 = 0 THEN '239,68,68,255' WHEN least(u, v) % 11 = 0 THEN '59,130,246,255' ELSE style END FROM al
  UNION ALL SELECT u, 'class', style FROM al)
SELECT mode, colour, count(*) AS edges, CAST(sum(u) AS BIGINT) AS nodes FROM md GROUP BY 1, 2""",
    "network_after_closures": BASE + """SELECT u, v, key, length FROM e WHERE least(u, v) % 7 <> 0 AND least(u, v) % 13 <> 0 AND NOT (least(u, v) % 11 = 0 AND CASE WHEN greatest(u, v) % 2 = 0 THEN u < v ELSE u > v END)""",
}
