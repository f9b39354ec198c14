"""One-way directions and what follows from them, against plain searches."""

import pytest

from blockweave.operators import access, blocks
from blockweave.plans.all import QUERIES

SF = "/root/testdata/sf0.001"


def reach(starts, arcs):
    seen, todo = set(starts), list(starts)
    while todo:
        v = todo.pop()
        for a, b in arcs:
            if a == v and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def left_of(arcs, changes):
    """Arcs that changes (lo, hi) -> (kind, direction) leave."""
    out = set()
    for u, v in arcs:
        kind, way = changes.get((min(u, v), max(u, v)), (None, None))
        if kind is None or kind == "one_way" and (u < v) == (way == "lo_to_hi"):
            out.add((u, v))
    return out


@pytest.mark.parametrize("way", ["lo_to_hi", "hi_to_lo", None])
def test_changes_follow_the_decided_direction(spark, way):
    """A ring of streets with a door at 1: the direction of (1, 2) and (3, 4) says what can be reached."""
    arcs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 1)]
    links = spark.createDataFrame([(7, u, v, 0, "interior") for u, v in arcs], "cell_id long, u long, v long, key long, role string")
    sectors = spark.createDataFrame([(7, 1, 0)], "cell_id long, node_id long, sector int")
    rows = [(7, 1, 2, "one_way", 6.0, way), (7, 3, 4, "one_way", 6.0, "hi_to_lo"), (7, 1, 5, "modal_filter", 1.0, None)]
    changes = spark.createDataFrame(rows, "cell_id long, lo long, hi long, kind string, cost double, direction string")
    plain = {(1, 2): ("one_way", way or "lo_to_hi"), (3, 4): ("one_way", "hi_to_lo"), (1, 5): ("modal_filter", None)}
    want = left_of(arcs, plain)
    assert {(r.u, r.v) for r in access.apply_changes(links, changes).collect()} == want
    lost = {r.node_id for r in access.unreachable(links, sectors, changes).collect()}
    assert lost == {1, 2, 3, 4, 5} - reach({1}, want) and 5 in lost
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 6)], "node_id long, x double, y double")
    why = {r.node_id: r.reason for r in access.diagnose(links, sectors, changes, access.unreachable(links, sectors, changes), nodes).collect()}
    assert why.keys() == lost and "one_way" in why[4]
    advice = access.suggest(links, sectors, changes, access.unreachable(links, sectors, changes)).first()
    opens = {c: len(lost & reach({1}, left_of(arcs, {k: v for k, v in plain.items() if k != c}))) for c in plain}
    worst = max(opens, key=lambda c: (opens[c], -c[0], -c[1]))
    assert (advice["worst_lo"], advice["worst_hi"], advice["opens"]) == (*worst, opens[worst])


def test_directions_are_decided_with_the_changes(spark):
    """Two doors of different sectors on a tertiary street: the cut is one-way, and its direction is the better one."""
    links = spark.createDataFrame([(1, u, v, 0, "interior") for u, v in [(1, 2), (2, 1), (3, 2)]], "cell_id long, u long, v long, key long, role string")
    sectors = spark.createDataFrame([(1, 1, 0), (1, 3, 1)], "cell_id long, node_id long, sector int")
    feats = spark.createDataFrame([(u, v, 0, "tertiary") for u, v in [(1, 2), (2, 1), (3, 2)]], "u long, v long, key long, highway string")
    row = blocks.street_changes(links, sectors, feats).collect()
    assert [(r.lo, r.hi, r.kind) for r in row] == [(2, 3, "one_way")]
    arcs = {1: {2}, 2: {1}, 3: {2}}
    score = {w: access.direction_score({k: v - ({2} if w == "lo_to_hi" and k == 3 else set()) for k, v in arcs.items()}, {1: 0, 3: 1}) for w in ("lo_to_hi", "hi_to_lo")}
    assert row[0]["direction"] == ("lo_to_hi" if score["lo_to_hi"] >= score["hi_to_lo"] else "hi_to_lo")


def test_reports_same_as_plain_searches(spark):
    """cell_access_report, city_totals and cell_violations_after_changes from the tables they stand on."""
    arcs, doors, changes, all_changes = {}, {}, {}, QUERIES["cell_street_changes"](spark, SF).collect()
    for r in QUERIES["cell_edges"](spark, SF).where("role = 'interior'").collect():
        arcs.setdefault(r.cell_id, set()).add((r.u, r.v))
    for r in QUERIES["cell_sectors"](spark, SF).collect():
        doors.setdefault(r.cell_id, {})[r.node_id] = r.sector
    for r in all_changes:
        changes[r.lo, r.hi] = (r.kind, r.direction)
    report, lost, broken = [], 0, set()
    for cell, own in arcs.items():
        left, nodes = left_of(own, changes), {x for a in own for x in a}
        gone = nodes - reach(doors.get(cell, {}), left)
        lost += len(gone)
        share = round(100 * (len(nodes) - len(gone)) / len(nodes) + 1e-9, 1)
        report.append((cell, len(nodes), len(gone), share, share >= 98))
        both = left | {(b, a) for a, b in left}
        for d, s in doors.get(cell, {}).items():
            broken |= {(cell, min(s, t), max(s, t)) for e, t in doors[cell].items() if t != s and e in reach({d}, both)}
    assert sorted(tuple(r) for r in QUERIES["cell_access_report"](spark, SF).collect()) == sorted(report)
    total = QUERIES["city_totals"](spark, SF).first()
    assert (total["modal_filters"], total["one_way"], total["unreachable"]) == (sum(r.kind == "modal_filter" for r in all_changes), sum(r.kind == "one_way" for r in all_changes), lost)
    assert {(r.cell_id, r.sector_a, r.sector_b) for r in QUERIES["cell_violations_after_changes"](spark, SF).collect()} == broken


@pytest.mark.parametrize(("kind", "way", "want"), [(None, None, {(0, 1): 2, (1, 0): 1}), ("one_way", "lo_to_hi", {(0, 1): 2}), ("one_way", "hi_to_lo", {(1, 0): 1}), ("modal_filter", None, {})])
def test_one_way_streets_mend_a_direction(spark, kind, way, want):
    """Entry 1 of a sector and entries 3 and 4 of another on 1-2-3, 2-4; the change is of 1-2."""
    pairs = [(1, 2), (2, 3), (2, 4)]
    links = spark.createDataFrame([(7, a, b, 0, "interior") for a, b in pairs + [p[::-1] for p in pairs]] + [(7, 3, 1, 0, "boundary")], "cell_id long, u long, v long, key int, role string")
    sectors = spark.createDataFrame([(7, 1, 0), (7, 3, 1), (7, 4, 1)], "cell_id long, node_id long, sector int")
    changes = spark.createDataFrame([(7, 1, 2, kind, 1.0, way)] if kind else [], "cell_id long, lo long, hi long, kind string, cost double, direction string")
    got = access.directed_violations(links, sectors, changes).collect()
    assert {(r.sector_from, r.sector_to): r.entries for r in got} == want
