"""Joins that stay even where one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions.lineage import cut

#: Keys that count as hot hold more than this part of all rows, so that there are fewer of them than this.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with a table of one row for each key, which says how many rows of ``left`` have the key.

    Keys with more than a thousandth of all rows, fewer than a thousand by that count, are
    told by a hash.  Their rows are sent to all tasks, so that the rows of ``left`` stay
    where they are; the other rows meet by key, in a merge join at every size.
    """
    right, code = cut(right), F.xxhash64(*on)
    least = (right.agg(F.sum(weight)).first()[0] or 0) // HOT
    hot = [r[0] for r in right.where(F.col(weight) > least).select(code).collect()]
    if not hot:
        return left.join(right.hint("merge"), on).drop(weight)
    here = left.where(code.isin(hot)).join(F.broadcast(right.where(code.isin(hot))), on)
    return here.unionByName(left.where(~code.isin(hot)).join(right.where(~code.isin(hot)).hint("merge"), on)).drop(weight)
