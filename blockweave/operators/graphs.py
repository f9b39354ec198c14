"""Graph operators: components, hop distances, edge betweenness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions.joins import join_hot
from blockweave.functions.lineage import cut
from blockweave.operators.wide_graphs import edge_shares


#: Rows of a round's tables in one task; rounds over few links stay in few files.
ROWS_IN_TASK = 20_000


def components(links: DataFrame) -> DataFrame:
    """(lo, hi) -> (node, label): the smallest node of each undirected component.

    Each round a label is hooked to the smallest label beside any of its nodes, and goes on
    to where that one is hooked; all its nodes follow.  A network is mostly one component,
    so after some rounds one label has most nodes, and most labels are beside it: their
    rows stay where they are, and the label's row is sent to them.
    """
    both = cut(links.select(F.col("lo").alias("node"), F.col("hi").alias("beside")).union(links.select("hi", "lo")).distinct())
    tasks = 1 + both.count() // ROWS_IN_TASK
    both = both.coalesce(tasks)
    # Rows of one task need no way around hot keys.
    join = join_hot if tasks > 1 else lambda left, right, on, weight: left.join(right, on).drop(weight)
    # What is written of a network is a small file with many rows, which Spark would send through the driver.
    unsent = (lambda df: df.hint("merge")) if tasks > 1 else (lambda df: df)
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("beside")).alias("label")).coalesce(tasks))
    while True:
        # A node's neighbours are as many as its streets, which are few; its label's nodes may be all there are.
        near = both.join(unsent(labels.select(F.col("node").alias("beside"), F.col("label").alias("l"))), "beside").groupBy("node").agg(F.min("l").alias("near"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("own"))
        seen = cut(labels.join(unsent(near), "node").coalesce(tasks))
        hooks = seen.groupBy("label").agg(F.count("*").alias("w"), F.min("near").alias("near"))
        hooks = cut(hooks.join(unsent(own), "label").select("label", "w", F.least("label", "near", "own").alias("next")).coalesce(tasks))
        if not hooks.where("next <> label").limit(1).count():
            return labels
        far = hooks.groupBy("next").agg(F.count("*").alias("n")).join(unsent(hooks.select(F.col("label").alias("next"), F.col("next").alias("far"))), "next", "left")
        jumped = join(hooks, far.select("next", "n", F.coalesce("far", "next").alias("far")), ["next"], "n").select("label", "w", F.col("far").alias("to"))
        labels = cut(join(seen.select("node", "label"), jumped, ["label"], "w").select("node", F.col("to").alias("label")).coalesce(tasks))


def hops(arcs: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(u, v) and (node) -> (node, hops): directed distance from the nearest start, up to a number of hops or to the end."""
    seen = cut(starts.select("node").distinct().withColumn("hops", F.lit(0)))
    edge = seen
    for k in count(1) if most is None else range(1, most + 1):
        step = edge.join(arcs.select(F.col("u").alias("node"), "v"), "node").select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti")
        edge = cut(step.withColumn("hops", F.lit(k)))
        if not edge.limit(1).count():
            break
        seen = cut(seen.union(edge))
    return seen


class _Net(NamedTuple):
    """A network as arrays: node ids in order, and for each node, by position, its arcs from start[k] to start[k + 1]."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray
    length: np.ndarray
    link: np.ndarray
    least: np.ndarray


def _net(lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> _Net:
    """The undirected network of links, fewer than 2**30; link is the number of an arc's link, least the shortest arc of a node."""
    ids = np.concatenate([lo, hi])
    ids.sort()
    ids = ids[np.append(True, ids[1:] != ids[:-1])] if len(ids) else ids
    start, to, link = _arcs(*(np.searchsorted(ids, x).astype(np.int32) for x in (lo, hi)), len(ids))
    length = length[link]
    return _Net(ids, start, to, length, link, np.minimum.reduceat(length, start[:-1]) if len(lo) else length)


def _arcs(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, to and link of a network; a node's arcs over links of which it is the lower end come first.  Small numbers, one end at a time, as a large network fills a task."""
    counts = [np.bincount(x, minlength=n).astype(np.int32) for x in (lo, hi)]
    start = np.zeros(n + 1, np.int64)
    np.cumsum(counts[0] + counts[1], out=start[1:])
    to, link = np.empty(2 * len(lo), np.int32), np.empty(2 * len(lo), np.int32)
    for own, other, count, first in ((lo, hi, counts[0], start[:-1]), (hi, lo, counts[1], start[:-1] + counts[0])):
        order = np.argsort(own, kind="stable").astype(np.int32)
        place = np.repeat((first - np.cumsum(count) + count).astype(np.int32), count)
        place += np.arange(len(own), dtype=np.int32)
        to[place], link[place] = other[order], order
    return start, to, link


def _shares(net: _Net, sources: np.ndarray) -> np.ndarray:
    """For each link, the shares of the shortest paths from the sources, nodes by position, summed.

    Dijkstra's search and Brandes' sums, for all sources at once and in phases: a phase
    settles all nodes that no pending node of their source can come before, those nearer
    than any pending node's distance and shortest arc.  A state is a node of a source.
    """
    n, size = len(net.ids), len(sources) * len(net.ids)
    to, first_arc = net.to, net.start[:-1]
    kind = np.int32 if size < 2**31 else np.int64
    best, ways, done, mark = np.full(size, np.inf), np.zeros(size), np.zeros(size, bool), np.empty(size, np.int32)
    of, node = np.arange(len(sources)), sources.astype(np.int64)
    pending = of * n + node
    best[pending], ways[pending] = 0.0, 1.0
    phases = []
    while pending.size:
        d = best[pending]
        reach = np.full(len(sources), np.inf)
        np.minimum.at(reach, of, d + net.least[node])
        now = d < reach[of]
        # Beside arcs of no length nodes settle one by one, by distance and id.
        free = np.zeros(len(sources), bool)
        free[of[now]] = True
        stuck = np.flatnonzero(~free[of]) if not free.all() else free[:0]
        if stuck.size:
            stuck = stuck[np.lexsort((pending[stuck], d[stuck], of[stuck]))]
            now[stuck[np.unique(of[stuck], return_index=True)[1]]] = True
        settled, at, own = pending[now], node[now], of[now]
        count = net.start[at + 1] - net.start[at]
        upto = np.cumsum(count)
        arcs = np.repeat(first_arc[at] - upto + count, count) + np.arange(upto[-1])
        came_from = np.repeat(np.arange(len(settled)), count)
        v = np.repeat(settled - at, count) + to[arcs]
        length, far, old, before = net.length[arcs], np.repeat(d[now], count), best[v], done[v]
        tight = np.flatnonzero(before & (old + length == far))
        v_tight, here = v[tight], came_from[tight]
        if tight.size:
            # A node's arcs lie together, and none of those before changes any more.
            ways[settled] += np.bincount(here, ways[v_tight], len(settled))
        phases.append((arcs[tight].astype(np.int32), v_tight.astype(kind), settled[here].astype(kind)))
        done[settled] = True
        far += length
        ahead = np.flatnonzero(~before & (far < old))
        v, old, far = v[ahead], old[ahead], far[ahead]
        np.minimum.at(best, v, far)
        # Of a node that is met several times the last meeting counts.
        fresh = np.flatnonzero(old == np.inf)
        mark[v[fresh]] = fresh
        fresh = fresh[mark[v[fresh]] == fresh]
        first, left = ahead[fresh], ~now
        pending, node, of = np.concatenate([pending[left], v[fresh]]), np.concatenate([node[left], to[arcs[first]]]), np.concatenate([of[left], own[came_from[first]]])
    # Distances have done their work.
    need, total = best, np.zeros(len(net.link) // 2)
    need[:] = 0.0
    while phases:
        arcs, v, w = phases.pop()
        share = ways[v] / ways[w] * (1 + need[w])
        np.add.at(need, v, share)
        np.add.at(total, net.link[arcs], share)
    return total


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of a part of a table as bytes, a row for each batch."""
    for b in batches:
        yield pa.RecordBatch.from_pydict({c: [b.column(c).to_numpy(zero_copy_only=False).tobytes()] for c in ("lo", "hi", "length")})


#: States (a node of a source) that a task searches at once, unless a source alone has more.
STATES = 1_000_000
#: Rows of a batch that a task gives back.
ROWS_GIVEN = 200_000


def analysis_pivots(n_nodes: int) -> int | None:
    """Sources of approximate betweenness: all below 2,500 nodes, else a tenth of the nodes, 200 to 800."""
    return None if n_nodes < 2500 else min(800, max(200, n_nodes // 10))


def betweenness(links: DataFrame, pivots: int | Callable[[int], int | None] | None = None, most_links: int = 16_000_000) -> DataFrame:
    """(lo, hi, length) -> (lo, hi, centrality): share of all shortest paths that use the edge.

    Sources are spread over tasks; each task gets the links of the network, whose number
    is checked before they are sent.  Above ``most_links`` paths are found by rounds of
    joins instead, with the same result.  With pivots (a number, or one by the number of nodes)
    only that many sources are used, those whose hash is smallest, and the result is scaled.
    """
    sources = cut(links.select(F.explode(F.array("lo", "hi")).alias("source")).distinct())
    n = sources.count()
    pivots = pivots(n) if callable(pivots) else pivots
    chosen = sources if pivots is None or pivots >= n else sources.orderBy(F.xxhash64("source"), "source").limit(pivots)
    k = n if pivots is None else min(pivots, n)
    scale = (n / k) / (n * (n - 1)) if n > 1 else 0.0
    if links.count() > most_links:
        sums = edge_shares(links, cut(chosen))
        return links.select("lo", "hi").join(sums, ["lo", "hi"], "left").select("lo", "hi", (F.coalesce("share", F.lit(0.0)) * F.lit(scale)).alias("centrality"))
    packs = links.select(F.col("lo").cast("long"), F.col("hi").cast("long"), F.col("length").cast("double")).mapInArrow(_packed, "lo binary, hi binary, length binary")
    packs = [tuple(r) for r in packs.toLocalIterator()]
    lo, hi, length = (np.concatenate([np.frombuffer(r[c], t) for r in packs] or [np.zeros(0, t)]) for c, t in enumerate((np.int64, np.int64, np.float64)))
    shared = links.sparkSession.sparkContext.broadcast((lo, hi, length))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = np.concatenate([b["source"].to_numpy(np.int64) for b in batches] or [np.zeros(0, np.int64)])
        if not asked.size:
            return
        net = _net(*shared.value)
        places, at_once = np.searchsorted(net.ids, asked), max(1, STATES // len(net.ids))
        total = sum(_shares(net, places[k : k + at_once]) for k in range(0, len(places), at_once))
        used = np.flatnonzero(total)
        for k in range(0, len(used), ROWS_GIVEN):
            e = used[k : k + ROWS_GIVEN]
            yield pd.DataFrame({"lo": shared.value[0][e], "hi": shared.value[1][e], "share": total[e]})

    # Each task gives back a row for each link, so there is one for each core; turns make them even.
    spread = chosen.repartition(max(1, min(k, links.sparkSession.sparkContext.defaultParallelism)))
    sums = spread.mapInPandas(run, "lo long, hi long, share double").groupBy("lo", "hi").agg(F.sum("share").alias("share"))
    return links.select("lo", "hi").join(sums, ["lo", "hi"], "left").select("lo", "hi", (F.coalesce("share", F.lit(0.0)) * F.lit(scale)).alias("centrality"))
