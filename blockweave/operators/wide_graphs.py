"""Shortest paths and betweenness of networks too large for one task, by rounds of joins.

A task is a source or a request.  Each round all tasks take one step along the arcs from
the nodes that changed; distances, predecessors and path counts are rows of tables, so no
node, network or task is held whole anywhere.  The number of rounds is the number of
streets on the longest shortest path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions.lineage import checkpoint_folder, cut


def distances(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """(u, v, cost) and (task, node) -> task, node, cost, came: the least cost from the task's start, and the node before, the smallest of equals."""
    best = cut(starts.select("task", "node", F.lit(0.0).alias("cost"), F.col("node").alias("came")).distinct())
    ahead = cut(arcs.groupBy(F.col("u").alias("node"), "v").agg(F.min("cost").cast("double").alias("c")))
    edge = best
    while True:
        step = edge.select("task", "node", "cost").join(ahead, "node").select("task", F.col("v").alias("node"), (F.col("cost") + F.col("c")).alias("new"), F.col("node").alias("via"))
        step = step.groupBy("task", "node").agg(F.min(F.struct("new", "via")).alias("m")).select("task", "node", "m.new", "m.via")
        both = step.join(best, ["task", "node"], "left")
        nearer = F.col("cost").isNull() | (F.col("new") < F.col("cost"))
        same = (F.col("new") == F.col("cost")) & (F.col("via") < F.col("came")) & (F.col("came") != F.col("node"))
        better = cut(both.where(nearer | same).select("task", "node", F.col("new").alias("cost"), F.col("via").alias("came"), nearer.alias("moved")))
        if not better.limit(1).count():
            return best
        best = cut(best.join(better.select("task", "node"), ["task", "node"], "left_anti").unionByName(better.drop("moved")))
        edge = better.where("moved")


def paths(arcs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, origin, destination) -> request_id, cost, path; both null if there is no way."""
    best = distances(arcs, requests.select(F.col("request_id").alias("task"), F.col("origin").alias("node")))
    asked = requests.select(F.col("request_id").alias("task"), "origin", F.col("destination").alias("node"))
    now = cut(asked.join(best.select("task", "node", "cost"), ["task", "node"], "left").select("task", "origin", "node", "cost", F.when(F.col("cost").isNotNull(), F.array("node")).alias("path")))
    before = best.select("task", "node", "came")
    while now.where("path is not null and node <> origin").limit(1).count():
        step = now.join(before, ["task", "node"], "left").withColumn("on", F.col("path").isNotNull() & (F.col("node") != F.col("origin")))
        now = cut(step.select("task", "origin", F.when(F.col("on"), F.col("came")).otherwise(F.col("node")).alias("node"), "cost", F.when(F.col("on"), F.concat(F.array("came"), "path")).otherwise(F.col("path")).alias("path")))
    return now.select(F.col("task").alias("request_id"), "cost", "path")


def _in_turn(tight: DataFrame, first: DataFrame, give, keep: str) -> DataFrame:
    """Values of nodes in the order of the arcs (task, v, w): a node has its value when all that come before have given theirs.

    first are the values (task, node, value) of nodes without any before; give is what an
    arc carries.  What arcs carry is kept as ``keep`` in a table (task, v, w, keep).
    """
    spark, folder = tight.sparkSession, f"{checkpoint_folder(tight.sparkSession)}/arcs-{uuid.uuid4().hex}"
    need = cut(tight.groupBy("task", F.col("w").alias("node")).agg(F.count("*").alias("need")))
    ready, waiting = first, None
    while ready.limit(1).count():
        sent = cut(tight.join(ready.withColumnRenamed("node", "v"), ["task", "v"]).select("task", "v", "w", give.alias(keep)))
        sent.write.mode("append").parquet(folder)
        got = sent.groupBy("task", F.col("w").alias("node")).agg(F.count("*").alias("got"), F.sum(keep).alias("value"))
        if waiting is not None:
            got = waiting.unionByName(got).groupBy("task", "node").agg(F.sum("got").alias("got"), F.sum("value").alias("value"))
        got = cut(got.join(need, ["task", "node"]))
        ready, waiting = got.where("got = need").select("task", "node", "value"), got.where("got < need").select("task", "node", "got", "value")
    return spark.read.schema(f"task long, v long, w long, {keep} double").parquet(folder)


def edge_shares(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(lo, hi, length) and (source) -> lo, hi, share: shares of the shortest paths from the sources over each street."""
    arcs = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.col("length").alias("cost")).union(links.select("hi", "lo", "length"))
    best = distances(arcs, sources.select(F.col("source").alias("task"), F.col("source").alias("node")))
    a, b = best.select("task", F.col("node").alias("v"), F.col("cost").alias("dv")), best.select("task", F.col("node").alias("w"), F.col("cost").alias("dw"))
    ends = arcs.select(F.col("u").alias("v"), F.col("v").alias("w"), "cost")
    tight = cut(a.join(ends, "v").join(b, ["task", "w"]).where("dv + cost = dw").select("task", "v", "w"))
    start = sources.select(F.col("source").alias("task"), F.col("source").alias("node"), F.lit(1.0).alias("value"))
    given = _in_turn(tight, start, F.col("value"), "given")
    ways = cut(given.groupBy("task", F.col("w").alias("node")).agg(F.sum("given").alias("ways")).unionByName(start.withColumnRenamed("value", "ways")))
    at = lambda c: ways.select("task", F.col("node").alias(c), F.col("ways").alias("ways_" + c))
    back = tight.join(at("v"), ["task", "v"]).join(at("w"), ["task", "w"])
    back = cut(back.select("task", F.col("w").alias("v"), F.col("v").alias("w"), (F.col("ways_v") / F.col("ways_w")).alias("part")))
    last = best.select("task", "node").join(tight.select("task", F.col("v").alias("node")).distinct(), ["task", "node"], "left_anti").withColumn("value", F.lit(0.0))
    shares = _in_turn(back, cut(last), F.col("part") * (1 + F.col("value")), "share")
    return shares.groupBy(F.least("v", "w").alias("lo"), F.greatest("v", "w").alias("hi")).agg(F.sum("share").alias("share"))
