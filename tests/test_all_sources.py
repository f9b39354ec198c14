"""The query for betweenness has all nodes as sources, however many there are."""

from pyspark.sql import functions as F

from blockweave.operators import graphs
from blockweave.plans import catalog


def test_edge_betweenness_counts_the_paths_of_all_nodes(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet").where("p_partkey < 2704")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.edge_betweenness(spark, str(tmp_path))
    want = graphs.betweenness(catalog._simple(spark, str(tmp_path)), None).withColumnRenamed("centrality", "c")
    both = got.join(want, ["lo", "hi"], "full").select(F.coalesce(F.abs(F.col("centrality") - F.col("c")), F.lit(9.0)).alias("gap"))
    assert got.count() == want.count() == 2 * 52 * 51
    assert both.agg(F.max("gap")).first()[0] < 1e-12
