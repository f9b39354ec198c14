"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions.joins import join_hot  # noqa: F401
from blockweave.functions.lineage import checkpoint_folder, cut, delete_folder  # noqa: F401

#: Bytes that separate words of the white-space kind; equal to what bytes.split() splits on.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text; equal rows share it, and nulls have a key too."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def held_out(id_col: str) -> Column:
    """True for rows whose crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes for the table to lack it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def sample_by_hash(df: DataFrame, limit: int, *by: str, id_col: str, text_col: str | None = None, seed: int = 7) -> DataFrame:
    """At most about 1.2 * limit + 32 rows of each group, the ones with the smallest hash of the id, and of the text if it is named.

    Group sizes are counted first, so that the rows are picked by a plain filter on
    the hash: no group is ever sorted or collected as a whole.  Equal rows share a hash;
    one of them is picked.
    """
    h = F.pmod(F.xxhash64(F.col(id_col), *([F.col(text_col)] if text_col else []), F.lit(seed)), F.lit(1 << 30))
    sizes = df.groupBy(*by).agg(F.greatest(F.count("*"), F.lit(1)).alias("_n")).withColumn(
        "_most", F.least(F.lit(1.0), F.lit(1.2 * limit) / F.col("_n") + F.lit(32.0) / F.col("_n")) * float(1 << 30)
    )
    picked = df.withColumn("_h", h)
    if by:
        match = [picked[c].eqNullSafe(sizes[c]) for c in by]
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        # A row for each group: callers group by columns of few values.
        picked = picked.join(F.broadcast(sizes), cond & (picked["_h"] < sizes["_most"]), "left_semi")
    else:
        most = sizes.first()["_most"]
        picked = picked.where(F.col("_h") < F.lit(most))
    return picked.drop("_h").distinct()
