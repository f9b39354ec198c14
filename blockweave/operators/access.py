"""Street changes applied to a network, and who can still reach what."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions.lineage import cut
from blockweave.operators.graphs import components
from blockweave.operators.wide_graphs import distances


def apply_changes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges that are left: a modal filter or closure (lo, hi) takes both directions, a one-way street the way against its direction.

    direction is lo_to_hi or hi_to_lo; without one, or where it is null, the way from hi to lo goes.
    """
    keyed = edges.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
    shut = changes.where("kind <> 'one_way'").select("lo", "hi").distinct()
    back = F.coalesce(F.col("direction") == "hi_to_lo", F.lit(False)) if "direction" in changes.columns else F.lit(False)
    one = changes.where("kind = 'one_way'").select(F.when(back, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(back, F.col("hi")).otherwise(F.col("lo")).alias("v")).distinct()
    return keyed.join(shut, ["lo", "hi"], "left_anti").join(one, ["u", "v"], "left_anti").drop("lo", "hi")


def _inside(links: DataFrame, changes: DataFrame | None) -> DataFrame:
    """Inner streets (cell_id, lo, hi) of which a way is left in either direction."""
    inner = links.where("role = 'interior'").select("cell_id", "u", "v")
    left = inner if changes is None else apply_changes(inner, changes)
    return left.select("cell_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()


def violations(links: DataFrame, sectors: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(cell_id, sector_a, sector_b, pairs): pairs of entries of different sectors that the cell's inner streets join.

    Entries are counted by component and sector first, so that no pair of entries is formed.
    """
    inner = _inside(links, changes)
    at = lambda c: F.struct(F.col("cell_id").alias("c"), F.col(c).alias("n"))
    labels = components(inner.select(at("lo").alias("lo"), at("hi").alias("hi"))).select(F.col("node.c").alias("cell_id"), F.col("node.n").alias("node_id"), "label")
    doors = sectors.join(labels, ["cell_id", "node_id"]).groupBy("cell_id", "label", "sector").agg(F.count("*").alias("n"))
    a, b = doors.alias("a"), doors.alias("b")
    both = a.join(b, (F.col("a.cell_id") == F.col("b.cell_id")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.sector") < F.col("b.sector")))
    return both.groupBy(F.col("a.cell_id").alias("cell_id"), F.col("a.sector").alias("sector_a"), F.col("b.sector").alias("sector_b")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("pairs"))


def violation_paths(links: DataFrame, sectors: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(cell_id, sector_a, sector_b, streets, path): for each two sectors that inner streets join, one shortest way from an entry of the one to an entry of the other.

    All entries of a sector search together, in rounds of joins, each node keeping the
    smallest node before it; of the nearest entries of the other sector the smallest one is
    taken.  So the path doesn't depend on the order of anything.
    """
    inner = cut(_inside(links, changes))
    at = lambda c: F.struct(F.col("cell_id").alias("c"), F.col(c).alias("n"))
    arcs = inner.select(at("lo").alias("u"), at("hi").alias("v"), F.lit(1.0).alias("cost")).union(inner.select(at("hi"), at("lo"), F.lit(1.0)))
    doors = cut(sectors.select(F.struct("cell_id", "sector").alias("task"), at("node_id").alias("node"), "sector"))
    best = distances(arcs, doors.select("task", "node"))
    met = best.join(doors.select("node", F.col("sector").alias("b")), "node").where(F.col("b") > F.col("task")["sector"])
    first = met.groupBy("task", "b").agg(F.min(F.struct("cost", "node")).alias("m"))
    now = cut(first.select("task", "b", F.col("m.cost").alias("streets"), F.col("m.node").alias("node"), F.array(F.col("m.node")["n"]).alias("path")))
    came = best.where("came <> node").select("task", "node", "came")
    done = None
    while now.limit(1).count():
        step = cut(now.join(came, ["task", "node"], "left"))
        ended = step.where("came is null").select("task", "b", "streets", "path")
        done = ended if done is None else done.unionByName(ended)
        now = step.where("came is not null").select("task", "b", "streets", F.col("came").alias("node"), F.concat(F.array(F.col("came")["n"]), "path").alias("path"))
    if done is None:
        done = now.select("task", "b", "streets", "path")
    return done.select(F.col("task.cell_id").alias("cell_id"), F.col("task.sector").alias("sector_a"), F.col("b").alias("sector_b"), F.col("streets").cast("int").alias("streets"), "path")


def directed_violations(links: DataFrame, sectors: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(cell_id, sector_from, sector_to, entries): entries of another sector that can be driven to from an entry of the first, on inner streets and in their direction.

    Unlike ``violations``, which asks for ways in either sense, a one-way street can mend
    one.  All entries of a sector search together, in rounds of joins.
    """
    inner = links.where("role = 'interior'").select("cell_id", "u", "v")
    left = inner if changes is None else apply_changes(inner, changes)
    at = lambda c: F.struct(F.col("cell_id").alias("c"), F.col(c).alias("n"))
    arcs = cut(left.select(at("u").alias("u"), at("v").alias("v"), F.lit(1.0).alias("cost")).distinct())
    doors = cut(sectors.select(F.struct("cell_id", "sector").alias("task"), at("node_id").alias("node"), "sector").distinct())
    met = distances(arcs, doors.select("task", "node")).select("task", "node").join(doors.select("node", F.col("sector").alias("b")), "node").where(F.col("b") != F.col("task")["sector"])
    return met.groupBy(F.col("task.cell_id").alias("cell_id"), F.col("task.sector").alias("sector_from"), F.col("b").alias("sector_to")).agg(F.countDistinct("node").alias("entries"))


def unreachable(links: DataFrame, sectors: DataFrame, changes: DataFrame) -> DataFrame:
    """(cell_id, node_id) of inner nodes that no entry reaches along the directed streets that are left.

    A cell's streets are one group; its size is bounded by the cell's.
    """
    inner = links.where("role = 'interior'").select("cell_id", "u", "v")
    left = apply_changes(inner, changes).select("cell_id", "u", "v")
    rows = inner.select("cell_id", F.explode(F.array("u", "v")).alias("u"), F.lit(None).cast("long").alias("v"), F.lit(0).alias("door")).distinct()
    rows = rows.unionByName(left.withColumn("door", F.lit(0))).unionByName(sectors.select("cell_id", F.col("node_id").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(1).alias("door")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        arcs: dict[int, list[int]] = {}
        for u, v in pdf.loc[pdf["v"].notna(), ["u", "v"]].itertuples(index=False):
            arcs.setdefault(int(u), []).append(int(v))
        seen = {int(u) for u in pdf.loc[pdf["door"] == 1, "u"]}
        queue = deque(seen)
        while queue:
            for w in arcs.get(queue.popleft(), ()):
                if w not in seen:
                    seen.add(w)
                    queue.append(w)
        lost = sorted({int(u) for u in pdf["u"]} - seen)
        return pd.DataFrame({"cell_id": [int(pdf["cell_id"].iloc[0])] * len(lost), "node_id": lost})

    return rows.groupBy("cell_id").applyInPandas(solve, "cell_id long, node_id long")


def report(links: DataFrame, lost: DataFrame) -> DataFrame:
    """Nodes, unreachable nodes and the reachable share of each cell; emergency services need 98 percent."""
    nodes = links.where("role = 'interior'").select("cell_id", F.explode(F.array("u", "v")).alias("node_id")).distinct().groupBy("cell_id").agg(F.count("*").alias("nodes"))
    gone = lost.groupBy("cell_id").agg(F.count("*").alias("unreachable"))
    t = nodes.join(gone, "cell_id", "left").withColumn("unreachable", F.coalesce("unreachable", F.lit(0)))
    share = F.round(100 * (F.col("nodes") - F.col("unreachable")) / F.col("nodes"), 1)
    return t.select("cell_id", "nodes", "unreachable", share.alias("reachable_percent"), (share >= 98).alias("emergency_ok"))


def _before(start: int, arcs: dict[int, list[int]]) -> dict[int, int]:
    """Each reached node with the node before it on a path of fewest streets, the smallest of equals."""
    before, level = {start: start}, [start]
    while level:
        found: dict[int, int] = {}
        for v in level:
            for w in arcs.get(v, ()):
                if w not in before:
                    found[w] = min(v, found.get(w, v))
        before |= found
        level = sorted(found)
    return before


def _cell_rows(links: DataFrame, sectors: DataFrame, changes: DataFrame, lost: DataFrame) -> DataFrame:
    """All that is known of a cell as rows (cell_id, what, u, v, kind, direction)."""
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = links.where("role = 'interior'").select("cell_id", F.lit("arc").alias("what"), "u", "v", text.alias("kind")).distinct()
    rows = rows.unionByName(sectors.select("cell_id", F.lit("door").alias("what"), F.col("node_id").alias("u"), none.alias("v"), text.alias("kind")))
    rows = rows.withColumn("direction", text)
    way = F.coalesce("direction", F.lit("lo_to_hi")) if "direction" in changes.columns else F.lit("lo_to_hi")
    rows = rows.unionByName(changes.select("cell_id", F.lit("change").alias("what"), F.col("lo").alias("u"), F.col("hi").alias("v"), "kind", way.alias("direction")))
    rows = rows.unionByName(lost.select("cell_id", F.lit("lost").alias("what"), F.col("node_id").alias("u"), none.alias("v"), text.alias("kind"), text.alias("direction")))
    return rows.join(lost.select("cell_id").distinct(), "cell_id", "left_semi")


class _Cell:
    def __init__(self, pdf: pd.DataFrame):
        self.cell = int(pdf["cell_id"].iloc[0])
        of = {k: g for k, g in pdf.groupby("what")}
        pairs = lambda k: [(int(u), int(v)) for u, v in of[k][["u", "v"]].itertuples(index=False)] if k in of else []
        nodes = lambda k: sorted({int(u) for u in of[k]["u"]}) if k in of else []
        self.arcs = sorted(set(pairs("arc")))
        self.doors, self.lost = nodes("door"), nodes("lost")
        #: Kind and direction of each changed street.
        self.changes = dict(zip(pairs("change"), zip(of["change"]["kind"], of["change"]["direction"], strict=True), strict=True)) if "change" in of else {}

    @staticmethod
    def shut(arc: tuple[int, int], changes: dict[tuple[int, int], tuple[str, str]]) -> bool:
        """True if a change takes the arc: a one-way street the way against its direction, others both."""
        kind, direction = changes.get((min(arc), max(arc)), (None, None))
        return kind is not None and (kind != "one_way" or (arc[0] > arc[1]) == (direction != "hi_to_lo"))

    def ahead(self, changes: dict) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for a in self.arcs:
            if not self.shut(a, changes):
                out.setdefault(a[0], []).append(a[1])
        return out

    def reached(self, changes: dict) -> set[int]:
        arcs = self.ahead(changes)
        return set().union(*[_reach(d, {k: set(v) for k, v in arcs.items()}) | {d} for d in self.doors]) if self.doors else set()


def diagnose(links: DataFrame, sectors: DataFrame, changes: DataFrame, lost: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell_id, node_id, nearest_sector, reason) of lost nodes.

    The sector is that of the nearest entry of the cell, the first by node of equals.  A node
    is isolated if no entry reached it before; else the kinds of changes on its paths of
    fewest streets from the entries are named.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = _Cell(pdf)
        trees = [_before(d, cell.ahead({})) for d in cell.doors]
        out = []
        for node in cell.lost:
            kinds = set()
            for before in trees:
                v = node
                while v in before and before[v] != v:
                    kinds |= {k for k, _ in [cell.changes.get((min(v, before[v]), max(v, before[v])), (None, None))] if k}
                    v = before[v]
            known = any(node in before for before in trees)
            reason = "Node was already isolated in original graph" if not known else "Blocked by modifications: " + ", ".join(sorted(kinds)) if kinds else "Disconnected after modifications (complex topology)"
            out.append((cell.cell, node, reason))
        return pd.DataFrame(out, columns=["cell_id", "node_id", "reason"])

    why = _cell_rows(links, sectors, changes, lost).groupBy("cell_id").applyInPandas(solve, "cell_id long, node_id long, reason string")
    at = nodes.select("node_id", "x", "y")
    here = lost.select("cell_id", "node_id").join(at, "node_id")
    door = sectors.join(at.withColumnsRenamed({"x": "dx", "y": "dy"}), "node_id").select("cell_id", F.col("node_id").alias("door"), "sector", "dx", "dy")
    d2 = (F.col("dx") - F.col("x")) * (F.col("dx") - F.col("x")) + (F.col("dy") - F.col("y")) * (F.col("dy") - F.col("y"))
    near = here.join(door, "cell_id").groupBy("cell_id", "node_id").agg(F.min_by("sector", F.struct(d2.alias("d2"), "door")).alias("nearest_sector"))
    return why.join(near, ["cell_id", "node_id"], "left").select("cell_id", "node_id", F.coalesce("nearest_sector", F.lit(0)).alias("nearest_sector"), "reason")


def suggest(links: DataFrame, sectors: DataFrame, changes: DataFrame, lost: DataFrame) -> DataFrame:
    """(cell_id, areas, lost, worst_lo, worst_hi, opens, advice) of cells with lost nodes.

    areas counts the components of the lost nodes among themselves.  The worst change is the
    one whose removal opens most lost nodes, the first of equals; it is named in the advice
    if it opens more than half of them.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = _Cell(pdf)
        lost_set, beside = set(cell.lost), {v: set() for v in cell.lost}
        for u, v in cell.arcs:
            if u in lost_set and v in lost_set:
                beside[u].add(v)
                beside[v].add(u)
        areas, left = 0, set(lost_set)
        while left:
            areas += 1
            left -= _reach(start := min(left), beside) | {start}
        opens = {c: len(lost_set & cell.reached({k: v for k, v in cell.changes.items() if k != c})) for c in cell.changes}
        worst = max(opens, key=lambda c: (opens[c], -c[0], -c[1]), default=None)
        if worst is not None and not opens[worst]:
            worst = None
        n, advice = len(lost_set), []
        if areas == 1 and n <= 5:
            advice.append(f"Small isolated area ({n} nodes). Consider pedestrian-only access or delivery time windows.")
        elif areas > 1:
            advice.append(f"{areas} disconnected areas found. Review superblock boundary placement.")
        if n > 10:
            advice.append("Large number of unreachable nodes. Consider splitting superblock into smaller units.")
        if worst is not None and opens[worst] > n * 0.5:
            advice.append(f"Modification at edge ({worst[0]}, {worst[1]}) blocks {opens[worst]} nodes. Consider alternative placement.")
        row = (cell.cell, areas, n, *(worst or (None, None)), opens.get(worst, 0), advice)
        return pd.DataFrame([row], columns=["cell_id", "areas", "lost", "worst_lo", "worst_hi", "opens", "advice"]).astype({"worst_lo": "Int64", "worst_hi": "Int64"})

    rows = _cell_rows(links, sectors, changes, lost)
    return rows.groupBy("cell_id").applyInPandas(solve, "cell_id long, areas int, lost int, worst_lo long, worst_hi long, opens int, advice array<string>")


def flagged(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with vehicle_blocked: true where a modal filter stands; nothing is taken away."""
    shut = changes.where("kind = 'modal_filter'").select("lo", "hi").distinct().withColumn("vehicle_blocked", F.lit(True))
    keyed = edges.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
    return keyed.join(shut, ["lo", "hi"], "left").withColumn("vehicle_blocked", F.coalesce("vehicle_blocked", F.lit(False))).drop("lo", "hi")


def inner_components(links: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(cell_id, node_id, label): the smallest node of each component of a cell's inner streets, those with a change of any kind left out."""
    at = lambda c: F.struct(F.col("cell_id").alias("c"), F.col(c).alias("n"))
    inner = _inside(links, None)
    inner = inner if changes is None else inner.join(changes.select("cell_id", "lo", "hi").distinct(), ["cell_id", "lo", "hi"], "left_anti")
    labels = components(inner.select(at("lo").alias("lo"), at("hi").alias("hi")))
    return labels.select(F.col("node.c").alias("cell_id"), F.col("node.n").alias("node_id"), F.col("label.n").alias("label"))


def city_totals(areas: DataFrame, changes: DataFrame, lost: DataFrame) -> DataFrame:
    """Cells, hectares, filters, one-way streets and unreachable nodes of a city, in a row."""
    parts = areas.select("area_ha", F.lit(0).alias("f"), F.lit(0).alias("o"), F.lit(0).alias("l"), F.lit(1).alias("c"))
    parts = parts.unionByName(changes.select(F.lit(0.0).alias("area_ha"), (F.col("kind") == "modal_filter").cast("int").alias("f"), (F.col("kind") == "one_way").cast("int").alias("o"), F.lit(0).alias("l"), F.lit(0).alias("c")))
    parts = parts.unionByName(lost.select(F.lit(0.0).alias("area_ha"), F.lit(0).alias("f"), F.lit(0).alias("o"), F.lit(1).alias("l"), F.lit(0).alias("c")))
    return parts.agg(F.sum("c").alias("cells"), F.round(F.sum("area_ha"), 2).alias("area_ha"), F.sum("f").alias("modal_filters"), F.sum("o").alias("one_way"), F.sum("l").alias("unreachable"))


def _reach(start: int, arcs: dict[int, set[int]]) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for w in arcs.get(todo.pop(), ()):
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen - {start}


def direction_score(arcs: dict[int, set[int]], sectors: dict[int, int], penalty: int = 1000) -> int:
    """Nodes that entries reach, less a penalty for each entry of another sector that they reach."""
    total = 0
    for door, sector in sectors.items():
        found = _reach(door, arcs)
        total += len(found) - penalty * sum(sectors.get(v, sector) != sector for v in found)
    return total


def one_way_directions(links: DataFrame, sectors: DataFrame, changes: DataFrame) -> DataFrame:
    """(cell_id, lo, hi) of one-way streets -> the direction with the better score; lo to hi of equals.

    A cell's streets are one group; its size is bounded by the cell's.
    """
    none = F.lit(None).cast("int")
    rows = links.where("role = 'interior'").select("cell_id", "u", "v", F.lit("arc").alias("what"), none.alias("sector"))
    rows = rows.unionByName(changes.select("cell_id", F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit("one_way").alias("what"), none.alias("sector")).distinct())
    rows = rows.unionByName(sectors.select("cell_id", F.col("node_id").alias("u"), F.lit(None).cast("long").alias("v"), F.lit("door").alias("what"), "sector"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        arcs: dict[int, set[int]] = {}
        for u, v in pdf.loc[pdf["what"] == "arc", ["u", "v"]].itertuples(index=False):
            arcs.setdefault(int(u), set()).add(int(v))
        doors = {int(u): int(s) for u, s in pdf.loc[pdf["what"] == "door", ["u", "sector"]].itertuples(index=False)}
        out = []
        for lo, hi in pdf.loc[pdf["what"] == "one_way", ["u", "v"]].itertuples(index=False):
            a, b = int(lo), int(hi)
            without = lambda x, y: {k: w - {y} if k == x else w for k, w in arcs.items()}
            there, back = direction_score(without(b, a), doors), direction_score(without(a, b), doors)
            out.append((int(pdf["cell_id"].iloc[0]), a, b, "lo_to_hi" if there >= back else "hi_to_lo", max(there, back)))
        return pd.DataFrame(out, columns=["cell_id", "lo", "hi", "direction", "score"])

    return rows.groupBy("cell_id").applyInPandas(solve, "cell_id long, lo long, hi long, direction string, score long")
