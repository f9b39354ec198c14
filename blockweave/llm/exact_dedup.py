"""Exact de-duplication with a heavy-hitter split.

Texts are equal when they are equal without white space (``[\\x20\\x09-\\x0D]``); a row is
told by the SHA-256 digest of its text without it.  Misra-Gries counters over all rows
name the digests that may be frequent: Spark's ``approx_top_k`` is that summary (counters
that are lowered together when there are too many, merged over all tasks).  Counting
those digests exactly verifies them; the few that hold more than a thousandth of all rows
are kept with their winner, count and digest, and are sent to the tasks, which settle
their rows where they lie.  All other digests have at most a thousandth of the rows and
meet by an ordinary shuffle.  What the counters say decides only which way a row takes:
either way gives the same result.

All work is in DataFrame functions.  Rows are written once as (row, id, digest, length),
about fifty bytes each, so that texts are read and hashed once and are never shuffled.

Defined results: a null text counts as empty, and all texts without anything but white
space are equal.  The longest original text (code points) stays, of equal ones the
smallest id; a null id comes after all others, and of repeated rows one stays.  An empty
table gives an empty result.  ``dedupe`` passes on all columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import cut, free_names

#: Digests with more than one in ``SHARE`` rows are frequent; there are fewer of them than that.
SHARE = 1000
#: Counters of a summary.  A digest of more than 2 * 3.5 / 16384 of the rows is always named, which is less than one in SHARE.
COUNTERS = 12_000
SPACES = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    """The text without white space; null as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """row (a number of its own), doc_id, digest (32 bytes) and n (code points of the original text) of every row."""
    text, row = F.col(text_col), F.monotonically_increasing_id() if row is None else row
    digest = F.unhex(F.sha2(without_space(text).cast("binary"), 256))
    return docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), digest.alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("n"))


def candidates(rows: DataFrame, counters: int = COUNTERS, most: int = SHARE) -> DataFrame:
    """Rows of the 2 * ``most`` digests that Misra-Gries counters over all rows name; those of more than one in ``most`` rows are among them."""
    # The counters hold 64-bit hashes; two digests that share one are both candidates, and counted apart.
    h = F.xxhash64("digest")
    top = rows.select(h.alias("h")).agg(F.expr(f"approx_top_k(h, {2 * most}, {counters})").alias("t"))
    named = top.select(F.explode("t").alias("t")).select(F.col("t.item").alias("h"))
    # At most 2 * ``most`` rows of eight bytes.
    return rows.join(F.broadcast(named), h == F.col("h"), "left_semi")


def _best(rows: DataFrame) -> DataFrame:
    """digest, group_size and the winner's (row, doc_id) of each digest."""
    order = F.struct(F.negative("n").alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    g = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("w"))
    return g.select("digest", "group_size", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"))


def classes(rows: DataFrame, share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """row, doc_id, digest, keep_id, group_size and kept of rows as ``digests`` gives them, written before."""
    least = rows.count() // share
    # Fewer than ``share`` digests can have more rows than that, so the table of winners is bounded.
    winners = cut(_best(candidates(rows, counters, share)).where(F.col("group_size") > least).coalesce(1))
    columns = ["row", "doc_id", "digest", "keep_id", "group_size", "keep_row"]
    here = rows.join(F.broadcast(winners), "digest").select(columns)
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    met = rest.join(_best(rest).hint("merge"), "digest").select(columns)
    return here.unionByName(met).withColumn("kept", F.col("row") == F.col("keep_row")).drop("keep_row")


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    out = classes(cut(digests(docs, id_col, text_col)), share, counters)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedupe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """One row of each class of equal texts, with its own columns.

    Rows are written with a number first, which no two of them share, so that they meet
    their verdicts one to one however often a row repeats.
    """
    (number,) = free_names(docs, "_row")
    numbered = cut(docs.withColumn(number, F.monotonically_increasing_id()))
    rows = cut(digests(numbered, id_col, text_col, F.col(number)))
    stay = classes(rows, share, counters).where("kept").select(F.col("row").alias(number))
    return numbered.join(stay.hint("merge"), number, "left_semi").drop(number)
