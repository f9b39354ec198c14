"""Traffic estimates from road classes, and real counts in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions import roads as R


def estimate(feats: DataFrame) -> DataFrame:
    """Features with capacity, estimated_load, estimated_volume and traffic_intensity."""
    out = feats.withColumns({"capacity": R.capacity(F.col("highway"), F.col("lanes")), "estimated_load": R.load(F.col("highway"))})
    out = out.withColumn("estimated_volume", R.volume(F.col("capacity"), F.col("estimated_load")))
    return out.withColumn("traffic_intensity", R.intensity(F.col("estimated_volume")))


def by_class(estimated: DataFrame) -> DataFrame:
    return estimated.groupBy("highway").agg(F.count("*").alias("n"), F.sum("capacity").alias("capacity"), F.sum("estimated_volume").alias("volume"))


def totals(estimated: DataFrame) -> DataFrame:
    t = estimated.agg(F.sum("capacity").alias("total_capacity"), F.sum("estimated_volume").alias("total_volume"))
    return t.withColumn("average_load", F.when(F.col("total_capacity") > 0, F.round(F.col("total_volume") / F.col("total_capacity"), 3)).otherwise(0.0))


def with_counts(estimated: DataFrame, counts: DataFrame) -> DataFrame:
    """Estimates replaced by counts (osmid, volume) where there are any; an id of 0 never matches."""
    c = counts.where("osmid <> 0").select("osmid", F.col("volume").alias("counted"))
    out = estimated.join(c, "osmid", "left")
    real = F.col("counted").isNotNull()
    load = F.when(F.col("capacity") > 0, F.least(F.lit(1.0), F.col("counted") / F.col("capacity"))).otherwise(0.0)
    return out.select(
        *[c for c in estimated.columns if c not in ("estimated_load", "estimated_volume", "traffic_intensity")],
        F.when(real, load).otherwise(F.col("estimated_load")).alias("estimated_load"),
        F.when(real, F.col("counted")).otherwise(F.col("estimated_volume")).cast("long").alias("estimated_volume"),
        F.when(real, R.intensity(F.col("counted"))).otherwise(F.col("traffic_intensity")).alias("traffic_intensity"),
        real.alias("is_real_data"),
    )
