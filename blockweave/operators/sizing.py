"""Recommended block sizes from grid geometry and population density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions import geometry as G

BINS, BIN_WIDTH = 36, 5
SIDES = {"min": 300.0, "base": 400.0, "max": 500.0}
CAP_BASE, CAP_MAX, DENSITY = 420.0, 504.0, 16000.0


def histogram(edges: DataFrame) -> DataFrame:
    """Street length by direction, in bins of five degrees; edges come with ux, uy, vx, vy."""
    angle = G.axis_angle(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))
    return edges.groupBy(F.least(F.floor(angle / BIN_WIDTH).cast("int"), F.lit(BINS - 1)).alias("bin")).agg(F.sum("length").alias("length"))


def grid(edges: DataFrame, n_nodes: int) -> DataFrame:
    """orientation, regularity and mean block side of a network."""
    h = histogram(edges)
    top = h.agg(F.max(F.struct("length", F.negative("bin").alias("b"))).alias("m")).select((-F.col("m.b") * BIN_WIDTH + BIN_WIDTH / 2).alias("o")).first()["o"]
    orientation = F.lit(float(top or 0.0))
    off = F.abs(G.axis_angle(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")) - orientation)
    away = F.least(off, 180 - off)
    aligned = (away <= 15) | (F.abs(away - 90) <= 15)
    return edges.agg(
        orientation.alias("orientation"), F.coalesce(F.sum(F.when(aligned, F.col("length")).otherwise(0.0)) / F.sum("length"), F.lit(0.5)).alias("regularity"), F.coalesce(F.sum("length") / max(1.0, n_nodes / 4) / 4, F.lit(100.0)).alias("block_m")
    )


def density_factor(density: Column) -> Column:
    r = density / DENSITY
    return F.when(density.isNull(), 1.0).when(r > 1.5, 0.8).when(r > 1, 0.9).when(r > 0.5, 1.0).when(r > 0.25, 1.1).otherwise(1.2)


def recommend(shape: DataFrame, density: float | None = None, latitude: float | None = None) -> DataFrame:
    """Sides in metres, areas in hectares and orientation for a row of ``grid``."""
    f = density_factor(F.lit(density).cast("double"))
    low, base, high = (F.lit(SIDES[k]) * f for k in ("min", "base", "max"))
    loose = F.col("regularity") < 0.5
    low, high = F.when(loose, low * 0.8).otherwise(low), F.when(loose, high * 1.2).otherwise(high)
    fitted = F.col("block_m") * 3.5
    base = F.when((fitted >= low) & (fitted <= high), fitted).otherwise(base)
    tilt = 0.0 if latitude is None else 15.0 if latitude > 0 else -15.0
    s = shape.select(low.alias("min_side"), F.least(base, F.lit(CAP_BASE)).alias("side"), F.least(high, F.lit(CAP_MAX)).alias("max_side"), (F.col("orientation") * 0.9 + 0.1 * tilt).alias("orientation"), "regularity")
    return s.withColumns({"min_ha": F.col("min_side") * F.col("min_side") / 10000, "ha": F.col("side") * F.col("side") / 10000, "max_ha": F.col("max_side") * F.col("max_side") / 10000})


def sector_count(ha: Column) -> Column:
    return F.when(ha < 6, 3).when(ha < 20, 4).when(ha < 30, 6).otherwise(8)
