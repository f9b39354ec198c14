"""Place search over a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.operators.spatial import nearest


def search(places: DataFrame, text: str, limit: int = 5, least: int = 2) -> DataFrame:
    """Places whose name holds the text, the most important first; a missing box is 0.01 degrees around the point.

    A text of fewer than ``least`` characters finds none (2 for the service, 3 for the box of a map).
    """
    places = places if len(text.strip()) >= least else places.limit(0)
    half = F.coalesce("half", F.lit(0.01))
    hits = places.where(F.lower("display_name").contains(text.lower()))
    out = hits.select(
        "place_id", "display_name", "lat", "lon", F.array(F.col("lat") - half, F.col("lat") + half, F.col("lon") - half, F.col("lon") + half).alias("box"),
        F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("importance", F.lit(0.0)).alias("importance"),
    )
    return out.orderBy(F.desc("importance"), "place_id").limit(limit)


def reverse(points: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, place_id) of the place nearest to each point (key, x, y)."""
    return nearest(points, places.select(F.col("place_id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y")), key).select(key, F.col("node_id").alias("place_id"))


def short_name(places: DataFrame) -> DataFrame:
    """The first two parts of each name."""
    return places.select("place_id", F.array_join(F.transform(F.slice(F.split("display_name", ","), 1, 2), lambda s: F.trim(s)), ", ").alias("short_name"))
