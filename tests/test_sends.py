"""Joins of network-size tables aren't sent through the driver, however small their files are."""

import pytest
from pyspark.sql import functions as F

from blockweave.functions.lineage import cut
from blockweave.operators import graphs, network
from blockweave.plans.all import QUERIES
from blockweave.sources import network as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_diagonals_meet_by_key(spark):
    assert "Broadcast" not in plan(QUERIES["noded_diagonals"](spark, SF))


@pytest.mark.parametrize("name", ["edge_lengths_on_sphere", "network_in_box"])
def test_ends_of_edges_meet_by_key(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


def test_cells_meet_by_key(spark):
    assert "Broadcast" not in plan(S.cells(spark, SF))


def test_labels_of_a_component_meet_by_key(spark):
    labels = spark.range(3).selectExpr("id as node", "id % 2 as label")
    kept = network.largest_component(labels).select(F.col("node").alias("u"))
    sent = plan(spark.range(3).selectExpr("id as u").join(kept, "u", "left_semi"))
    assert sent.count("BroadcastHashJoin") == 1  # the label, a row


def test_rounds_of_components_meet_by_key(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graphs, "ROWS_IN_TASK", 10)
    monkeypatch.setattr(graphs, "cut", lambda df: plans.append(plan(df)) or cut(df))
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91)], "lo long, hi long")
    got = {r.node: r.label for r in graphs.components(links).collect()}
    assert got == dict.fromkeys(range(41), 0) | {90: 90, 91: 90}
    # Only the rows of hot labels are sent.
    assert not any("BroadcastHashJoin" in p for p in plans if "to#" not in p and "far#" not in p) and len(plans) > 5
