"""Street features, totals, simple views and statistics of a road network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweave.functions import roads as R
from blockweave.functions.lineage import cut

MAX_SPAN = 0.5


def valid_box(north: Column, south: Column, east: Column, west: Column) -> Column:
    """Reason why a box is refused, or null."""
    h, w = north - south, east - west
    return F.when((h > MAX_SPAN) | (w > MAX_SPAN), "too large").when((h <= 0) | (w <= 0), "inverted")


def with_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends: ux, uy, vx, vy."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return edges.join(a, "u").join(b, "v")


def in_box(edges: DataFrame, nodes: DataFrame, north: float, south: float, east: float, west: float) -> DataFrame:
    """Edges with an end in the box; the box reaches the scan of the nodes."""
    inside = nodes.where(F.col("x").between(west, east) & F.col("y").between(south, north)).select("node_id")
    ends = edges.join(inside.withColumnRenamed("node_id", "u"), "u", "left_semi").select("u", "v", "key").union(edges.join(inside.withColumnRenamed("node_id", "v"), "v", "left_semi").select("u", "v", "key"))
    return edges.join(ends.distinct(), ["u", "v", "key"], "left_semi")


def features(edges: DataFrame) -> DataFrame:
    """One row for each edge with normalised attributes."""
    name = R.road_class(F.col("highway"))
    return edges.select(
        "u", "v", "key", F.coalesce(F.get("osmid", F.lit(0)), F.lit(0)).alias("osmid"), name.alias("highway"), R.best_rank(F.col("highway")).alias("hierarchy"),
        R.lanes(F.col("lanes")).alias("lanes"), R.oneway(F.col("oneway")).alias("oneway"), R.maxspeed(F.col("maxspeed")).alias("maxspeed"), F.round("length", 2).alias("length_m"),
    )


def class_totals(feats: DataFrame) -> DataFrame:
    return feats.groupBy("highway").agg(F.count("*").alias("n"), F.sum("length_m").alias("length_m"))


def totals(feats: DataFrame) -> DataFrame:
    return feats.agg(F.count("*").alias("total_edges"), F.round(F.sum("length_m") / 1000, 2).alias("total_length_km"))


def simple(edges: DataFrame, weight: Column, name: str = "weight") -> DataFrame:
    """Undirected simple view: one row (lo, hi) with the smallest weight of its edges."""
    return edges.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min(weight).alias(name))


def first_length(edges: DataFrame) -> DataFrame:
    """Undirected simple view with the length of the edge that comes first by (u, v, key)."""
    return edges.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min_by("length", F.struct("u", "v", "key")).alias("length"))


def index_percentile(values: DataFrame, column: str, percent: int) -> DataFrame:
    """The element at floor(n * percent / 100) of the sorted values, and n; nulls of both for none.

    Values are counted, and the counts range-partitioned; sums of the ranges, a row each,
    tell in which range the element lies, and only that one is put in order.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(parts, "value").withColumn("range", F.spark_partition_id()))
    sums = sorted((r["range"], r["c"]) for r in ranged.groupBy("range").agg(F.sum("c").alias("c")).collect())
    n = sum(c for _, c in sums)
    rank, before = n * percent // 100, 0
    for here, c in sums:  # noqa: B007
        if before + c > rank:
            break
        before += c
    if not n:
        return ranged.agg(F.min("value").alias("value"), F.sum("c").alias("n"))
    upto = F.sum("c").over(W.partitionBy("range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) + before
    found = ranged.where(F.col("range") == here).withColumn("upto", upto).where(F.col("upto") > rank)
    return found.agg(F.min("value").alias("value"), F.lit(n).cast("long").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    ends = simple(edges, F.col("length")).select(F.explode(F.array("lo", "hi")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def boundary_edges(feats: DataFrame, most: int = 5) -> DataFrame:
    return feats.where(F.col("hierarchy") <= most)


def arterial_edges(feats: DataFrame) -> DataFrame:
    return feats.where(F.col("highway").isin(*R.ARTERIAL))


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes (node, label) of the component with most nodes; the smallest label of equals.  They meet others by key, as they may be the whole network."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max(F.struct(F.col("n"), F.negative("label").alias("l"))).alias("m")).select(F.negative("m.l").alias("label"))
    return labels.join(F.broadcast(top), "label", "left_semi").hint("merge")  # top is one row
