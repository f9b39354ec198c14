"""Road networks: nodes, directed multi-edges, addresses, counts and cells.

``nodes`` and ``edges`` read a street grid that is derived from the ``part`` table by
arithmetic with exact binary fractions, so that sums don't depend on their order.
Any other network with the same columns can be used in their place.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsent(df: DataFrame) -> DataFrame:
    """A table whose joins meet by key at every size.

    The tables that networks are derived from are small files with many rows: the size that
    Spark expects of a few of their columns would have whole networks sent through the driver.
    """
    return df.hint("merge")


def grid_width(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Columns of the grid, and nodes; both from the row count alone."""
    n = table(spark, sf_dir, "part").count()
    return ceil(sqrt(n)), n


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, cx, cy, x, y."""
    gw, _ = grid_width(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % gw).alias("cx"), F.floor(F.col("p_partkey") / F.lit(float(gw))).alias("cy"))
    return unsent(part.withColumns({"x": F.lit(19.0) + F.col("cx") / F.lit(1024.0), "y": F.lit(47.5) + F.col("cy") * F.lit(5.0) / F.lit(8192.0)}))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each street between neighbours, with the attributes of its lower node."""
    gw, n = grid_width(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("u"), F.col("p_size").cast("long").alias("s"), F.col("p_type").alias("kind"))
    part = part.withColumns({"cx": F.col("u") % gw, "cy": F.floor(F.col("u") / F.lit(float(gw)))})
    part = part.withColumn("axis", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.when(F.col("axis") == 0, F.col("u") + 1).otherwise(F.col("u") + gw))
    part = part.where((F.col("v") < n) & ((F.col("axis") == 1) | (F.col("cx") + 1 < gw)))
    line, s = F.when(F.col("axis") == 0, F.col("cy")).otherwise(F.col("cx")), F.col("s")
    return unsent(part).select(
        "u", "v", F.col("axis").cast("long").alias("axis"), "s", (F.col("u") * 4 + F.col("axis") * 2).alias("osmid"),
        F.when(line % 16 == 0, "primary").when(line % 8 == 0, "secondary").when(line % 4 == 0, "tertiary").when(s == 50, "trunk").when(F.col("kind") == "ECONOMY", "living_street").when(F.col("kind") == "SMALL", "service").when(F.col("kind") == "PROMO", "unclassified").otherwise("residential").alias("highway"),
        F.when(s % 7 == 0, "2;3").when(s % 7 == 1, F.lit(None)).when(s % 7 == 2, "2").when(s % 7 == 3, "3").otherwise("1").alias("lanes"),
        F.when(s % 5 == 0, F.lit(None)).when(s % 5 == 2, "30 mph").when(s % 5 == 3, "walk").otherwise("50").alias("maxspeed"),
        F.when(s % 10 == 0, "yes").otherwise("no").alias("oneway"),
        (F.when(F.col("axis") == 0, F.lit(73.25)).otherwise(F.lit(68.0)) + s * F.lit(0.25)).alias("length"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (u, v, key) with osmid, highway, lanes and maxspeed as arrays, oneway, length and name, an array or null."""
    s = streets(spark, sf_dir)
    forward = s.withColumn("key", F.lit(0))
    back = s.where("oneway = 'no'").withColumns({"u": F.col("v"), "v": F.col("u"), "key": F.lit(0)})
    twin = s.where("s % 25 = 7").withColumns({"key": F.lit(1), "osmid": F.col("osmid") + 1, "length": F.col("length") + 5})
    every = forward.unionByName(back).unionByName(twin)
    more = F.when(F.col("s") % 13 == 0, F.array("osmid", F.col("osmid") + 1000000)).otherwise(F.array("osmid"))
    title = F.concat(F.lit("Street "), F.least("u", "v").cast("string"))
    names = F.when(F.col("s") % 3 == 0, F.array(title, F.lit(""), title, F.lit("Ring"))).when(F.col("s") % 3 == 1, F.array(title))
    return unsent(every).select("u", "v", "key", more.alias("osmid"), F.array("highway").alias("highway"), F.array("lanes").alias("lanes"), "oneway", F.array("maxspeed").alias("maxspeed"), "length", names.alias("name"))


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, key, geom) of the edges that aren't straight: those of streets with s divisible by 4, with a bend in the middle."""
    n = nodes(spark, sf_dir)
    bent = streets(spark, sf_dir).where("s % 4 = 0").select("u", "v")
    bent = bent.join(n.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(n.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    middle = point((F.col("ux") + F.col("vx")) / 2 + F.lit(1 / 16384), (F.col("uy") + F.col("vy")) / 2)
    return bent.select("u", "v", F.lit(0).alias("key"), F.array(point(F.col("ux"), F.col("uy")), middle, point(F.col("vx"), F.col("vy"))).alias("geom"))


def of_kind(edges: DataFrame, kind: str) -> DataFrame:
    """Edges of a network for driving, cycling or walking, or all: footways and paths carry no cars, motorways only cars."""
    name = F.coalesce(F.get("highway", F.lit(0)), F.lit("unclassified"))
    if kind == "all":
        return edges
    if kind == "drive":
        return edges.where(~name.isin("footway", "path", "cycleway", "pedestrian", "steps"))
    return edges.where(~name.isin("motorway", "motorway_link", *(("footway", "steps") if kind == "bike" else ())))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address_id, x, y."""
    gw, _ = grid_width(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address_id"))
    return unsent(c).withColumns({"x": F.lit(19.0) + (F.col("address_id") * 7919 % (gw * 64)) / F.lit(65536.0), "y": F.lit(47.5) + (F.col("address_id") * 104729 % (gw * 40)) / F.lit(65536.0)})


def traffic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osmid, volume."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") * 4).alias("osmid")).agg((F.count("*") * 37).alias("volume"))


def cells(spark: SparkSession, sf_dir: str, blocks: int = 4) -> DataFrame:
    """Rectangles of blocks by blocks streets whose corners are all on the grid: cell_id, ring."""
    n = nodes(spark, sf_dir).where(f"cx % {blocks} = 0 and cy % {blocks} = 0").select("node_id", "cx", "cy", "x", "y")
    far = n.select((F.col("cx") - blocks).alias("cx"), (F.col("cy") - blocks).alias("cy"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return n.join(far, ["cx", "cy"]).select(F.col("node_id").alias("cell_id"), F.array(point("x", "y"), point("x1", "y"), point("x1", "y1"), point("x", "y1"), point("x", "y")).alias("ring"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with a point, a box for most of them, a kind and an importance."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("place_id"), F.concat(F.col("n_name"), F.lit(", District "), F.col("n_regionkey").cast("string"), F.lit(", World")).alias("display_name"), F.col("n_regionkey").cast("long").alias("r"))
    n = n.withColumns({"lat": F.lit(40.0) + F.col("place_id") / F.lit(4.0), "lon": F.lit(10.0) + F.col("place_id") / F.lit(8.0)})
    size = F.when(F.col("place_id") % 5 != 0, (F.col("r") + 1) / F.lit(16.0))
    return n.withColumns({"half": size, "type": F.when(F.col("place_id") % 7 != 0, "city"), "importance": F.when(F.col("place_id") % 3 != 0, (F.col("place_id") % 10) / F.lit(16.0))})
