"""Connected components of an undirected edge list, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import cut, join_hot


#: Rows of a round's tables in one task; rounds over few links stay in few files.
ROWS_IN_TASK = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node of the component; nodes without an edge have no row.

    Each round every node takes the smallest label beside it and then its label's
    label; labels and counts stay in tables, and a round's lineage is cut.  A node that
    many are beside, and a label that many have, are met without moving those rows.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("beside")).union(edges.select("b", "a")).distinct())
    tasks = 1 + both.count() // ROWS_IN_TASK
    both = both.coalesce(tasks)
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("beside")).alias("label")).coalesce(tasks))
    degree = cut(both.groupBy("beside").agg(F.count("*").alias("w")).coalesce(tasks))
    while True:
        theirs = labels.select(F.col("node").alias("beside"), F.col("label").alias("l")).join(degree.hint("merge"), "beside").coalesce(tasks)
        near = join_hot(both, theirs, ["beside"], "w").groupBy("node").agg(F.min("l").alias("near"))
        stepped = cut(labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")).coalesce(tasks))
        sizes = stepped.groupBy("label").agg(F.count("*").alias("w"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next")).join(sizes.hint("merge"), "label").coalesce(tasks)
        new = cut(join_hot(stepped, jump, ["label"], "w").select("node", "old", F.least("label", "next").alias("label")).coalesce(tasks))
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels
