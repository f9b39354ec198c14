"""Mixing sources to target weights by exact budgets.

Every document gets a hash-random key.  Documents are range-sorted by source and key;
a last part of the sort key is the row's own number, so that ranges are alike in size
also where an id or a source has a third of all rows.  Sums of token counts over the
ranges of a source and a running sum inside each range together are a distributed
prefix sum, and the mix is cut where it reaches the source's budget.  Budgets above the
source's size repeat whole epochs first.

Defined results: a null text has no words, so it takes none.  A null source is a
source of its own, last in order.  Repeated rows each count; rows of one key are
ordered by id and size, so rows that tie are equal in what they take.  An empty
table gives an empty result with the same columns.  Other columns are passed on
by ``mix`` unless they have the name of a result column, which replaces them; rows are
written with a number there, so that each of several equal rows gets its own share.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockweave.llm.common import cut, free_names, text_key

#: Rows in a range on average, at most; there are at least as many ranges as shuffle partitions.
ROWS_IN_RANGE = 1_000_000


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of words between white space; null counts as 0."""
    return pa.array([len(t.split()) if t else 0 for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2) -> DataFrame:
    """source, n, source_size -> and target: share of the whole by weight, at most ``epochs`` times the source.

    What a full source can't take is shared again by weight.  In the order of
    size per weight the full sources come first, so one running sum over the
    catalogue of sources (a row per source) finds them.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(epochs)))
    t = t.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("whole", F.sum("source_size").over(every) * F.lit(float(share)))
    left = F.col("whole") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("full", left > F.col("ratio") * weight_left)
    full_sum = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    level = (F.col("whole") - full_sum) / open_weight
    return t.select("source", "n", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None) -> DataFrame:
    """key (of id and text unless another is given), doc_id, source, size, source_size, target, taken of every row; taken counts words, repeats included."""
    slim = cut(
        docs.select(
            (text_key(id_col, text_col) if key is None else key).alias("key"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("deal"),
        )
    )
    by_source = targets(slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, share, epochs)
    # Null sources take part in joins as text; a row's own number parts rows that are equal in all else.
    slim = slim.withColumns({"at": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "tie": F.xxhash64(F.monotonically_increasing_id())})
    order = ["deal", "doc_id", "size", "tie"]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slim.count() // ROWS_IN_RANGE + 1)
    placed = cut(slim.repartitionByRange(ranges, "at", *order).withColumn("range", F.spark_partition_id()))
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "at", "range").agg(F.sum("size").alias("s"))
    offsets = offsets.withColumn("base", F.coalesce(F.sum("s").over(before("at").orderBy("range")), F.lit(0)))
    offsets = offsets.join(by_source, offsets["source"].eqNullSafe(by_source["source"])).select("at", "range", "base", "source_size", "target")
    placed = placed.join(offsets, ["at", "range"])
    placed = placed.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(before("at", "range").orderBy(*order)), F.lit(0)))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("key", "doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken."""
    made = ["size", "source_size", "target", "taken"]
    (number,) = free_names(docs, "_row")
    numbered = cut(docs.withColumn(number, F.monotonically_increasing_id()))
    parts = plan(numbered, key=F.col(number), **options).where("taken > 0").select(F.col("key").alias(number), *made)
    return numbered.drop(*made).join(parts.hint("merge"), number).drop(number)
