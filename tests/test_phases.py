"""Betweenness in phases over arrays, against a search with a heap, node by node."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest

from blockweave.operators import graphs


def by_heap(source, links):
    """Shares of the shortest paths from a source, by link."""
    beside = defaultdict(list)
    for k, (a, b, length) in enumerate(links):
        beside[a].append((b, length, k))
        beside[b].append((a, length, k))
    best, ways, before, done, order, heap = {source: 0.0}, {source: 1.0}, defaultdict(list), set(), [], [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for w, length, k in beside[v]:
            if w not in done and d + length < best.get(w, float("inf")):
                best[w], ways[w], before[w] = d + length, ways[v], [(v, k)]
                heapq.heappush(heap, (d + length, w))
            elif w not in done and d + length == best[w]:
                ways[w] += ways[v]
                before[w].append((v, k))
    need, out = defaultdict(float), np.zeros(len(links))
    for w in reversed(order):
        for v, k in before[w]:
            share = ways[v] / ways[w] * (1 + need[w])
            need[v] += share
            out[k] += share
    return out


def net_of(links):
    lo, hi, length = zip(*links, strict=True)
    return graphs._net(np.array(lo), np.array(hi), np.array(length, float))


@pytest.mark.parametrize("seed", range(40))
def test_same_as_by_heap(seed):
    """With ties, several components, and arcs without length in every other network."""
    turn = random.Random(seed)
    n = turn.randrange(3, 14)
    links = [(a * 5, b * 5, float(turn.randrange(seed % 2, 4))) for a in range(n) for b in range(a + 1, n) if turn.random() < 0.35] or [(0, 5, 1.0)]
    net = net_of(links)
    sources = np.arange(len(net.ids))
    want = sum(by_heap(int(s), links) for s in net.ids)
    assert graphs._shares(net, sources) == pytest.approx(want)
    assert sum(graphs._shares(net, sources[k : k + 1]) for k in sources) == pytest.approx(want)


def test_networks_of_sixty_times_the_tables_are_sent_as_small_arrays():
    w = 300
    links = [(y * w + x, v, 70.0 + (x * y) % 17) for y in range(w) for x in range(w) for v in ([y * w + x + 1] if x + 1 < w else []) + ([y * w + x + w] if y + 1 < w else [])]
    net = net_of(links)
    assert sum(a.nbytes for a in net) < 50 * len(links)
    most = graphs.betweenness.__defaults__[-1]
    assert most > 2_400_000 and most * 24 < 400_000_000
