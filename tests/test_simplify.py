"""Simplification against a walk along each chain, and components against a search."""

import random

import pytest

from blockweave.operators import graphs, simplify

EDGE = "u long, v long, key int, osmid array<long>, highway array<string>, lanes array<string>, oneway string, maxspeed array<string>, length double, name array<string>"


def walk(arcs):
    """(u, v, lengths, osmids) of each chain; rings become loops at their smallest node."""
    ends = {}
    for u, v, *_ in arcs:
        ends.setdefault(u, ([], []))[1].append(v)
        ends.setdefault(v, ([], []))[0].append(u)

    def passed(x):
        into, out = map(sorted, ends[x])
        return x not in into + out and (len(into) == len(out) == 1 and into != out or len(into) == 2 and into == out and into[0] != into[1])

    through = {x for x in ends if passed(x)}
    left, out = set(arcs), []

    def follow(e, stop):
        chain = [e]
        while chain[-1][1] in through and chain[-1][1] != stop:
            chain.append(next(f for f in arcs if f[0] == chain[-1][1] and f[1] != chain[-1][0]))
        left.difference_update(chain)
        out.append((chain[0][0], chain[-1][1], [c[3] for c in chain], [c[4] for c in chain]))

    for e in sorted(arcs):
        if e[0] not in through:
            follow(e, None)
    while left:
        e = min(left)
        follow(e, e[0])
    return out


def table(spark, arcs):
    rows = [(u, v, k, [o], ["a" if o % 2 else "b"], None, "no", ["50"], n, [f"s{o % 3}"]) for u, v, k, n, o in arcs]
    return spark.createDataFrame(rows, EDGE)


def both(*pairs, start=0):
    out = []
    for k, (a, b) in enumerate(pairs):
        out += [(a, b, 0, 1.0 + (start + k) / 8, start + k), (b, a, 0, 1.0 + (start + k) / 8, start + k)]
    return out


def one(*pairs, start=50):
    return [(a, b, 0, 2.0 + (start + k) / 16, start + k) for k, (a, b) in enumerate(pairs)]


CASES = {
    "two-way chain": both((1, 2), (2, 3), (3, 4)),
    "one-way chain": one((1, 2), (2, 3), (3, 4), (4, 9), (9, 5)),
    "one-way into two-way": both((1, 2), (2, 3)) + one((3, 4), (4, 5)),
    "ring alone, both ways": both((7, 8), (8, 9), (9, 7)),
    "ring alone, one way": one((12, 10), (10, 11), (11, 12)),
    "loop at a junction": both((1, 2), (2, 3), (3, 1), (1, 4)),
    "self-loop": both((1, 2), (2, 3)) + one((2, 2)),
    "two ways between junctions": both((1, 5), (5, 2), (1, 6), (6, 7), (7, 2), (2, 3), (1, 4), (1, 8), (2, 9)),
    "parallel edges stop a chain": both((1, 2), (2, 3)) + [(1, 2, 1, 9.0, 99)],
    "long chain and everything": both(*[(k, k + 1) for k in range(100, 170)], (1, 100), (170, 2), (1, 3), (2, 3), (3, 4)) + one((201, 202), (202, 203), (203, 201), start=300),
}


def test_same_as_walking(spark):
    """All cases side by side, as networks that share no node."""
    arcs = [(u + 1000 * k, v + 1000 * k, key, n, o + 1000 * k) for k, case in enumerate(CASES.values()) for u, v, key, n, o in case]
    names = sorted({x for a in arcs for x in a[:2]})
    nodes = spark.createDataFrame([(k, float(k), k / 2) for k in names], "node_id long, x double, y double")
    got = simplify.simplified(table(spark, arcs).repartition(3), nodes).collect()
    want = walk(arcs)
    made = sorted((r.u, r.v, r.length, list(r.osmid), r.n_pieces) for r in got)
    assert made == sorted((u, v, sum(n), list(dict.fromkeys(o)), len(n)) for u, v, n, o in want)
    for r in got:
        assert (r.geom[0].x, r.geom[-1].x) == (r.u, r.v) and len(r.geom) == r.n_pieces + 1
        assert set(r.highway) == {"a" if o % 2 else "b" for o in r.osmid} and list(r.lanes) == []
    pairs = [(r.u, r.v, r.key) for r in got]
    assert len(set(pairs)) == len(pairs)
    rings = {7 + 1000 * k for k, n in enumerate(CASES) if n == "ring alone, both ways"} | {10 + 1000 * k for k, n in enumerate(CASES) if n == "ring alone, one way"} | {201 + 1000 * (len(CASES) - 1)}
    assert rings <= {u for u, *_ in want}
    assert sorted(r.u for r in simplify.simplified(table(spark, arcs), nodes, keep_rings=False).collect()) == sorted(u for u, *_ in want if u not in rings)


@pytest.mark.parametrize(("seed", "rows"), [(1, 20_000), (2, 30)])
def test_components_same_as_search(spark, seed, rows, monkeypatch):
    monkeypatch.setattr(graphs, "ROWS_IN_TASK", rows)
    r = random.Random(seed)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 100 + r.randrange(1, 40)) for _ in range(30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(25)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    top = {x: x for p in pairs for x in p}
    for _ in top:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    got = {x.node: x.label for x in graphs.components(spark.createDataFrame(pairs, "lo long, hi long")).collect()}
    assert got == top
