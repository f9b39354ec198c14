"""SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

# Fixed values of the classes that the derived network has; written out, so that nothing is shared with the library.
RANK = "CASE highway WHEN 'trunk' THEN 2 WHEN 'primary' THEN 3 WHEN 'secondary' THEN 4 WHEN 'tertiary' THEN 5 WHEN 'residential' THEN 6 WHEN 'living_street' THEN 7 WHEN 'unclassified' THEN 8 WHEN 'service' THEN 9 ELSE 99 END"
CAPACITY = "CASE highway WHEN 'trunk' THEN 1600 WHEN 'primary' THEN 800 WHEN 'secondary' THEN 600 WHEN 'tertiary' THEN 400 WHEN 'residential' THEN 200 WHEN 'living_street' THEN 100 WHEN 'unclassified' THEN 300 WHEN 'service' THEN 150 ELSE 200 END"
LOAD = "CASE highway WHEN 'trunk' THEN 0.65 WHEN 'primary' THEN 0.60 WHEN 'secondary' THEN 0.50 WHEN 'tertiary' THEN 0.40 WHEN 'residential' THEN 0.30 WHEN 'living_street' THEN 0.20 WHEN 'unclassified' THEN 0.35 WHEN 'service' THEN 0.25 ELSE 0.3 END"
SCORE_CAPACITY = "CASE highway WHEN 'trunk' THEN 1800 WHEN 'primary' THEN 900 WHEN 'secondary' THEN 700 WHEN 'tertiary' THEN 500 WHEN 'residential' THEN 300 WHEN 'living_street' THEN 100 WHEN 'unclassified' THEN 250 WHEN 'service' THEN 150 ELSE 200 END"

BASE = """
WITH g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS gw, count(*) AS n FROM part),
nodes AS (SELECT p_partkey AS node_id, p_partkey % gw AS cx, CAST(floor(p_partkey / CAST(gw AS DOUBLE)) AS BIGINT) AS cy FROM part, g),
nodes2 AS (SELECT *, 19.0::DOUBLE + cx / 1024.0::DOUBLE AS x, 47.5::DOUBLE + cy * 5.0::DOUBLE / 8192.0::DOUBLE AS y FROM nodes),
st0 AS (SELECT p_partkey AS u, p_partkey + 1 AS v, 0 AS axis, CAST(p_size AS BIGINT) AS s, p_type AS kind, CAST(floor(p_partkey / CAST(gw AS DOUBLE)) AS BIGINT) AS line FROM part, g WHERE p_partkey % gw + 1 < gw AND p_partkey + 1 < n
  UNION ALL SELECT p_partkey, p_partkey + gw, 1, CAST(p_size AS BIGINT), p_type, p_partkey % gw FROM part, g WHERE p_partkey + gw < n),
st AS (SELECT u, v, s, u * 4 + axis * 2 AS osmid,
  CASE WHEN line % 16 = 0 THEN 'primary' WHEN line % 8 = 0 THEN 'secondary' WHEN line % 4 = 0 THEN 'tertiary' WHEN s = 50 THEN 'trunk' WHEN kind = 'ECONOMY' THEN 'living_street' WHEN kind = 'SMALL' THEN 'service' WHEN kind = 'PROMO' THEN 'unclassified' ELSE 'residential' END AS highway,
  CASE WHEN s % 7 = 2 THEN 2 WHEN s % 7 = 3 THEN 3 ELSE 1 END AS lanes,
  CASE WHEN s % 5 = 2 THEN 30 WHEN s % 5 IN (0, 3) THEN NULL ELSE 50 END AS maxspeed, s % 10 = 0 AS oneway,
  (CASE WHEN axis = 0 THEN 73.25::DOUBLE ELSE 68.0::DOUBLE END) + s * 0.25::DOUBLE AS length FROM st0),
e AS (SELECT u, v, 0 AS key, osmid, highway, lanes, maxspeed, oneway, length, s FROM st
  UNION ALL SELECT v, u, 0, osmid, highway, lanes, maxspeed, oneway, length, s FROM st WHERE NOT oneway
  UNION ALL SELECT u, v, 1, osmid + 1, highway, lanes, maxspeed, oneway, length + 5, s FROM st WHERE s % 25 = 7),
f AS (SELECT *, """ + RANK + """ AS hierarchy, """ + CAPACITY + """ * lanes AS capacity, CAST(""" + LOAD + """ AS DOUBLE) AS load FROM e),
t AS (SELECT *, CAST(trunc(capacity * load) AS INTEGER) AS volume FROM f),
ti AS (SELECT *, least(100, CAST(trunc(volume / 1500.0::DOUBLE * 100) AS INTEGER)) AS intensity FROM t),
simple AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, min(length) AS length FROM e GROUP BY 1, 2),
cells AS (SELECT a.node_id AS cell_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM nodes2 a JOIN nodes2 b ON b.cx = a.cx + 4 AND b.cy = a.cy + 4 WHERE a.cx % 4 = 0 AND a.cy % 4 = 0),
addr AS (SELECT c_custkey AS address_id, 19.0::DOUBLE + (c_custkey * 7919 % (gw * 64)) / 65536.0::DOUBLE AS x, 47.5::DOUBLE + (c_custkey * 104729 % (gw * 40)) / 65536.0::DOUBLE AS y FROM customer, g),
ends AS (SELECT e.*, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM e JOIN nodes2 a ON a.node_id = e.u JOIN nodes2 b ON b.node_id = e.v),
links AS (SELECT c.cell_id, d.u, d.v, d.key, CASE WHEN (d.ux = d.vx AND d.ux IN (c.x0, c.x1)) OR (d.uy = d.vy AND d.uy IN (c.y0, c.y1)) THEN 'boundary' ELSE 'interior' END AS role, d.osmid, d.highway, d.lanes, d.ux, d.uy, d.vx, d.vy
  FROM cells c JOIN ends d ON d.ux BETWEEN c.x0 AND c.x1 AND d.vx BETWEEN c.x0 AND c.x1 AND d.uy BETWEEN c.y0 AND c.y1 AND d.vy BETWEEN c.y0 AND c.y1)
"""

ORACLE_SQL = {
    "network_features": BASE + "SELECT u, v, key, osmid, highway, hierarchy, lanes, oneway, maxspeed, round(length, 2) AS length_m FROM f",
    "network_class_totals": BASE + "SELECT highway, count(*) AS n, sum(length) AS length_m FROM f GROUP BY highway",
    "network_totals": BASE + "SELECT count(*) AS total_edges, round(sum(length) / 1000, 2) AS total_length_km FROM f",
    "network_in_box": BASE + "SELECT u, v, key, length FROM ends WHERE (ux BETWEEN 19.005 AND 19.02 AND uy BETWEEN 47.505 AND 47.515) OR (vx BETWEEN 19.005 AND 19.02 AND vy BETWEEN 47.505 AND 47.515)",
    "traffic_features": BASE + "SELECT u, v, key, capacity, load AS estimated_load, volume AS estimated_volume, intensity AS traffic_intensity FROM ti",
    "traffic_estimate": BASE + "SELECT highway, count(*) AS n, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(volume) AS BIGINT) AS volume FROM t GROUP BY highway",
    "traffic_totals": BASE + "SELECT CAST(sum(capacity) AS BIGINT) AS total_capacity, CAST(sum(volume) AS BIGINT) AS total_volume, round(sum(volume) / CAST(sum(capacity) AS DOUBLE), 3) AS average_load FROM t",
    "traffic_real_counts": BASE + """, c AS (SELECT user_id * 4 AS osmid, count(*) * 37 AS counted FROM events WHERE user_id <> 0 GROUP BY 1)
SELECT u, v, key, CASE WHEN counted IS NULL THEN load WHEN capacity > 0 THEN least(1.0::DOUBLE, counted / CAST(capacity AS DOUBLE)) ELSE 0 END AS estimated_load, CAST(coalesce(counted, volume) AS BIGINT) AS estimated_volume,
  CASE WHEN counted IS NULL THEN intensity ELSE least(100, CAST(trunc(counted / 1500.0::DOUBLE * 100) AS INTEGER)) END AS traffic_intensity, counted IS NOT NULL AS is_real_data FROM ti LEFT JOIN c USING (osmid)""",
    "simple_graph": BASE + "SELECT lo, hi, length FROM simple",
    "simple_first_length": BASE + "SELECT least(u, v) AS lo, greatest(u, v) AS hi, arg_min(length, (u, v, key)) AS length FROM e GROUP BY 1, 2",
    "simple_cut_cost": BASE + "SELECT least(u, v) AS lo, greatest(u, v) AS hi, min(11 - " + RANK + ") AS cost FROM e GROUP BY 1, 2",
    "node_degree": BASE + "SELECT node_id, count(*) AS degree FROM (SELECT lo AS node_id FROM simple UNION ALL SELECT hi FROM simple) GROUP BY node_id",
    "length_percentile_70": BASE + "SELECT length AS value, n FROM (SELECT length, row_number() OVER (ORDER BY length) AS r, count(*) OVER () AS n FROM e) WHERE r = floor(n * 70 / 100) + 1",
    "length_percentile_75_simple": BASE + "SELECT length AS value, n FROM (SELECT length, row_number() OVER (ORDER BY length) AS r, count(*) OVER () AS n FROM simple) WHERE r = floor(n * 75 / 100) + 1",
    "boundary_edges": BASE + "SELECT u, v, key, highway FROM f WHERE hierarchy <= 5",
    "arterial_edges": BASE + "SELECT u, v, key, highway FROM f WHERE highway IN ('primary', 'secondary', 'tertiary')",
    "cell_areas": BASE + """, m AS (SELECT *, 6378137.0::DOUBLE * radians(x1 - x0) * 6378137.0::DOUBLE * (ln(tan(pi() / 4 + radians(y1) / 2)) - ln(tan(pi() / 4 + radians(y0) / 2))) / 10000 AS a FROM cells)
SELECT cell_id, round(a, 4) AS mercator_ha, round(4 * pi() * (x1 - x0) * (y1 - y0) / pow(2 * (x1 - x0) + 2 * (y1 - y0), 2), 6) AS roundness, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM m""",
    "cell_edges": BASE + "SELECT cell_id, u, v, key, role FROM links",
    "cell_entries": BASE + ", x AS (SELECT cell_id, role, unnest([u, v]) AS node_id FROM links) SELECT cell_id, node_id FROM x GROUP BY 1, 2 HAVING count(*) FILTER (role = 'boundary') > 0 AND count(*) FILTER (role = 'interior') > 0",
    "cell_adjacency": BASE + "SELECT a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON a.cell_id < b.cell_id AND ((a.x1 = b.x0 AND a.y0 = b.y0) OR (a.y1 = b.y0 AND a.x0 = b.x0))",
    "address_cell": BASE + "SELECT a.address_id, min(c.cell_id) AS cell_id FROM addr a JOIN cells c ON a.x >= c.x0 AND a.x < c.x1 AND a.y >= c.y0 AND a.y < c.y1 GROUP BY 1",
    "address_nearest_node": BASE + """, h AS (SELECT a.address_id, n.node_id, (n.x - a.x) * (n.x - a.x) + (n.y - a.y) * (n.y - a.y) AS d2 FROM addr a JOIN nodes2 n ON abs(n.x - a.x) <= 0.005 AND abs(n.y - a.y) <= 0.005),
p AS (SELECT address_id, arg_min(node_id, (d2, node_id)) AS node_id FROM h GROUP BY 1) SELECT address_id, node_id FROM p""",
    "cell_sectors": BASE + """, x AS (SELECT cell_id, role, unnest([u, v]) AS node_id FROM links),
en AS (SELECT cell_id, node_id FROM x GROUP BY 1, 2 HAVING count(*) FILTER (role = 'boundary') > 0 AND count(*) FILTER (role = 'interior') > 0),
an AS (SELECT en.cell_id, en.node_id, atan2(n.y - (c.y0 + c.y1) / 2, n.x - (c.x0 + c.x1) / 2) + pi() / 4 AS a FROM en JOIN cells c USING (cell_id) JOIN nodes2 n USING (node_id))
SELECT cell_id, node_id, least(CAST(floor((a - 2 * pi() * floor(a / (2 * pi()))) / (pi() / 2)) AS INTEGER), 3) AS sector FROM an""",
    "cell_interventions": BASE + """, k AS (SELECT l.*, """ + RANK + """ AS hier, sqrt(pow((ux + vx) / 2 - (x0 + x1) / 2, 2) + pow((uy + vy) / 2 - (y0 + y1) / 2, 2)) / sqrt((x1 - x0) * (y1 - y0)) AS far FROM links l JOIN cells USING (cell_id)),
w AS (SELECT *, CASE WHEN role = 'boundary' THEN 'no_change' WHEN hier <= 5 THEN 'one_way' WHEN far < 0.3 THEN 'pedestrianize' WHEN hier >= 7 THEN 'modal_filter' ELSE 'local_access' END AS action FROM k)
SELECT cell_id, u, v, key, action, CASE WHEN action = 'one_way' THEN CASE WHEN osmid % 2 = 0 THEN 'forward' ELSE 'backward' END END AS direction FROM w""",
    "direction_histogram": BASE + "SELECT CASE WHEN uy = vy THEN 0 ELSE 18 END AS bin, sum(length) AS length FROM ends GROUP BY 1",
    "place_search": """WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name || ', District ' || n_regionkey || ', World' AS display_name, 40.0::DOUBLE + n_nationkey / 4.0::DOUBLE AS lat, 10.0::DOUBLE + n_nationkey / 8.0::DOUBLE AS lon,
  CASE WHEN n_nationkey % 5 <> 0 THEN (n_regionkey + 1) / 16.0::DOUBLE ELSE 0.01::DOUBLE END AS half, CASE WHEN n_nationkey % 7 <> 0 THEN 'city' ELSE 'unknown' END AS type, CASE WHEN n_nationkey % 3 <> 0 THEN (n_nationkey % 10) / 16.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM nation)
SELECT place_id, display_name, lat, lon, [lat - half, lat + half, lon - half, lon + half] AS box, type, importance FROM p WHERE lower(display_name) LIKE '%district 1%' ORDER BY importance DESC, place_id LIMIT 5""",
    "place_short_names": "SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name || ', District ' || n_regionkey AS short_name FROM nation",
    "cache_stats": "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'analysis' ELSE 'search' END AS cache_type, count(*) AS entries, CAST(sum(length(s_name)) AS BIGINT) AS bytes, min(1700000000.0::DOUBLE + s_suppkey * 60) AS oldest FROM supplier GROUP BY 1",
    "cache_live": "SELECT s_suppkey, md5((CASE s_suppkey % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'analysis' ELSE 'search' END) || ':{\"id\": ' || s_suppkey || '}') AS cache_key FROM supplier WHERE NOT ((s_suppkey % 5) * 600 > 0 AND 1700003600.0::DOUBLE > 1700000000.0::DOUBLE + s_suppkey * 60 + (s_suppkey % 5) * 600)",
    "progress_events": "SELECT event_type AS stage, CAST(event_id % 101 AS INTEGER) AS percent, 'user ' || user_id AS message, 'progress' AS type FROM events",
    "traffic_colours": BASE + "SELECT u, v, key, concat_ws(',', CAST(least(255, CAST(floor(intensity / 100.0::DOUBLE * 255) AS BIGINT)) AS VARCHAR), CAST(least(255, CAST(floor((1 - intensity / 100.0::DOUBLE) * 200) AS BIGINT)) AS VARCHAR), '50', '220') AS colour FROM ti",
    "hourly_traffic": "SELECT user_id * 4 AS osmid, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) * 37 AS volume FROM events GROUP BY 1, 2",
    "components": BASE + "SELECT node_id AS node, 0::BIGINT AS label FROM nodes",
    "component_reach": BASE + ", h AS (SELECT node_id AS node, cx + cy AS hops FROM nodes WHERE cx + cy <= 6) SELECT node, CAST(hops AS INTEGER) AS hops FROM h",
    "block_faces_summary": BASE + ", a AS (SELECT count(*) AS c FROM cells) SELECT c AS full_cells FROM a",
    "edge_ids": BASE + ", x AS (SELECT u, v, key, osmid, unnest(CASE WHEN s % 13 = 0 THEN [osmid, osmid + 1000000] ELSE [osmid] END) AS id, s FROM e) SELECT u, v, key, CASE WHEN osmid > 0 THEN osmid WHEN s % 13 = 0 THEN osmid + 1000000 ELSE 0 END AS first_id, id AS osmid FROM x WHERE id > 0",
    "edge_lengths_on_sphere": BASE + ", h AS (SELECT *, pow(sin(radians(vy - uy) / 2), 2) + cos(radians(uy)) * cos(radians(vy)) * pow(sin(radians(vx - ux) / 2), 2) AS a FROM ends) SELECT u, v, key, round(2 * 6371000.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM h",
    "cell_geojson": BASE + "SELECT cell_id, 5 AS points, x1 AS x, y1 AS y FROM cells",
    "cell_simple_scores": BASE + """, n AS (SELECT cell_id, count(*) FILTER (role = 'interior') AS i, count(*) FILTER (role = 'boundary') AS b FROM links GROUP BY 1),
m AS (SELECT cells.cell_id, i, b, 6378137.0::DOUBLE * radians(x1 - x0) * 6378137.0::DOUBLE * (ln(tan(pi() / 4 + radians(y1) / 2)) - ln(tan(pi() / 4 + radians(y0) / 2))) / 10000 AS ha, 4 * pi() * (x1 - x0) * (y1 - y0) / pow(2 * (x1 - x0) + 2 * (y1 - y0), 2) AS q FROM cells JOIN n USING (cell_id))
SELECT cell_id, greatest(0, least(100, 50 + CASE WHEN ha BETWEEN 9 AND 16 THEN 20 WHEN ha BETWEEN 6 AND 20 THEN 10 WHEN ha < 4 OR ha > 25 THEN -10 ELSE 0 END
  + CASE WHEN i = 0 THEN 15 WHEN i <= 5 THEN 10 WHEN i <= 10 THEN 5 WHEN i > 20 THEN -10 ELSE 0 END + CASE WHEN b >= 4 THEN 10 WHEN b < 2 THEN -15 ELSE 0 END + CASE WHEN q > 0.7 THEN 10 WHEN q > 0.5 THEN 5 WHEN q < 0.3 THEN -5 ELSE 0 END)) AS score FROM m""",
    "network_after_changes": BASE + "SELECT u, v, key, length FROM e WHERE NOT (least(u, v) % 7 = 0) AND NOT (least(u, v) % 11 = 0 AND u > v)",
    "progress_display": """WITH p AS (SELECT event_id, CAST(event_id % 300 AS DOUBLE) AS elapsed, CAST(event_id % 101 AS DOUBLE) AS percent FROM events)
SELECT event_id, round(CASE WHEN percent <= 0 THEN 90.0::DOUBLE ELSE greatest(0, elapsed / (percent / 100) - elapsed) END, 3) AS remaining, printf('%d:%02d', CAST(floor(elapsed / 60) AS BIGINT), CAST(elapsed AS BIGINT) % 60) AS clock, CASE WHEN percent >= 70 THEN 'good' WHEN percent >= 50 THEN 'ok' ELSE 'poor' END AS band, CAST(event_id % 10 AS INTEGER) AS colour FROM p""",
    "road_runs": """WITH a AS (SELECT user_id * 4 AS osmid, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT osmid, ts, sum(fresh) OVER (PARTITION BY osmid ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM a)
SELECT osmid, min(ts) AS first_event, max(ts) AS last_event, count(*) * 37 AS vehicles FROM b GROUP BY osmid, run""",
    "traffic_sessions": """WITH a AS (SELECT user_id * 4 AS osmid, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT osmid, ts, sum(fresh) OVER (PARTITION BY osmid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM a) SELECT osmid, min(ts) AS start, count(*) AS n FROM b GROUP BY osmid, k""",
    "sliding_traffic": "WITH a AS (SELECT user_id * 4 AS osmid, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events), w AS (SELECT osmid, b AS start FROM a UNION ALL SELECT osmid, b - INTERVAL '30 minutes' FROM a) SELECT osmid, start, count(*) * 37 AS volume FROM w GROUP BY 1, 2",
}
ORACLE_SQL["cell_sector_counts"] = "SELECT cell_id, sector, count(*) AS entries FROM (" + ORACLE_SQL["cell_sectors"] + ") GROUP BY 1, 2"
ORACLE_SQL["cell_area_models"] = (
    BASE
    + """, w AS (SELECT *, cos(radians((y0 + y1) / 2)) AS c FROM cells),
h AS (SELECT *, c * c * pow(sin(radians(x1 - x0) / 2), 2) AS aw, pow(sin(radians(y1 - y0) / 2), 2) AS ah FROM w)
SELECT cell_id, round(2 * 6371000.0::DOUBLE * atan2(sqrt(aw), sqrt(1 - aw)) * 2 * 6371000.0::DOUBLE * atan2(sqrt(ah), sqrt(1 - ah)) / 10000, 4) AS box_ha, round((x1 - x0) * (y1 - y0) * 111320 * 111320 * c / 10000, 4) AS approximate_ha FROM h"""
)
ORACLE_SQL["noded_diagonals"] = (
    BASE
    + """, up AS (SELECT a.node_id * 2 AS seg_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM nodes2 a JOIN nodes2 b ON b.cx = a.cx + 1 AND b.cy = a.cy + 1),
down AS (SELECT a.node_id * 2 + 1 AS seg_id, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2 FROM nodes2 a JOIN nodes2 b ON b.cx = a.cx + 1 AND b.cy = a.cy JOIN nodes2 c ON c.cx = a.cx AND c.cy = a.cy + 1),
al AS (SELECT *, seg_id // 2 AS block FROM up UNION ALL SELECT *, seg_id // 2 FROM down),
two AS (SELECT block FROM al GROUP BY block HAVING count(*) = 2)
SELECT seg_id, 1 AS piece, round(x1, 9) AS x1, round(y1, 9) AS y1 FROM al UNION ALL SELECT seg_id, 2, round((x1 + x2) / 2, 9), round((y1 + y2) / 2, 9) FROM al WHERE block IN (SELECT block FROM two)"""
)
ORACLE_SQL["top_cells"] = "SELECT * FROM (" + ORACLE_SQL["cell_simple_scores"] + ") ORDER BY score DESC, cell_id LIMIT 20"
ORACLE_SQL["street_status"] = (
    BASE
    + """, r AS (SELECT u, v, key, max(CASE WHEN role = 'boundary' THEN 1 ELSE 0 END) AS edge FROM links GROUP BY 1, 2, 3)
SELECT u, v, key, CASE WHEN least(u, v) % 7 = 0 THEN 'modal_filter' WHEN least(u, v) % 11 = 0 THEN 'one_way' WHEN edge = 1 THEN 'perimeter' WHEN edge = 0 THEN 'interior' ELSE highway END AS status FROM f LEFT JOIN r USING (u, v, key)"""
)
ORACLE_SQL["arterial_ids"] = BASE + "SELECT DISTINCT osmid FROM f WHERE highway IN ('primary', 'secondary', 'tertiary')"
ORACLE_SQL["change_counts"] = BASE + "SELECT CASE WHEN lo % 7 = 0 THEN 'modal_filter' ELSE 'one_way' END AS kind, count(*) AS n FROM simple WHERE lo % 7 = 0 OR lo % 11 = 0 GROUP BY 1"
ORACLE_SQL["sector_suggestions"] = BASE + ", a AS (SELECT cell_id, (x1 - x0) * (y1 - y0) * 111320 * 111320 * cos(radians((y0 + y1) / 2)) / 10000 AS ha FROM cells) SELECT cell_id, CASE WHEN ha < 6 THEN 3 WHEN ha < 20 THEN 4 WHEN ha < 30 THEN 6 ELSE 8 END AS sectors FROM a"
ORACLE_SQL["stages_of_events"] = "SELECT CAST(event_id % 6 + 1 AS INTEGER) AS step, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1"
