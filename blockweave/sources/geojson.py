"""GeoJSON text of rings, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "type string, coordinates array<array<array<double>>>"


def polygon(ring: Column) -> Column:
    """A polygon as a struct, to be part of a larger text."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    return F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))


def to_polygon(ring: Column) -> Column:
    return F.to_json(polygon(ring))


def from_polygon(text: Column) -> Column:
    """The outer ring."""
    outer = F.get(F.from_json(text, POLYGON)["coordinates"], F.lit(0))
    return F.transform(outer, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def feature(ring: Column, properties: Column) -> Column:
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
