"""Results of city partitions by the box they were made for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _to_five(c: Column) -> Column:
    """The nearest multiple of 1e-5 of the double itself, halves away from zero; ``round`` would take the digits that the double prints as."""
    v = F.abs(c) * 1e5
    whole = F.floor(v).cast("double")
    near = (whole + F.when(v - whole >= 0.5, 1.0).otherwise(0.0)) / 1e5
    return F.when(c < 0, F.negative(near)).otherwise(near)


def box_key(north: Column, south: Column, east: Column, west: Column) -> Column:
    """A box to five decimals as text."""
    return F.concat_ws("_", *[F.format_string("%.5f", _to_five(c)) for c in (north, south, east, west)])


class PartitionStore:
    """A folder of tables, one for each box; a later partition of the same box takes the place of the earlier one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, box: tuple[float, float, float, float]) -> str:
        west, south, east, north = box
        return f"{self.folder}/box={north:.5f}_{south:.5f}_{east:.5f}_{west:.5f}"

    def put(self, box: tuple[float, float, float, float], blocks: DataFrame) -> None:
        blocks.write.mode("overwrite").parquet(self._path(box))

    def get(self, box: tuple[float, float, float, float]) -> DataFrame | None:
        """The blocks of exactly this box, or None."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(box))
        found = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.parquet(self._path(box)) if found else None


def first_box(requests: DataFrame, boxes: DataFrame) -> DataFrame:
    """(request_id, box_id) of the first box, by its number, that holds both ends of a request; boxes are few and checked.

    requests have request_id, ox, oy, dx, dy; boxes have box_id, west, south, east, north.
    """
    n = boxes.count()
    if n > 10_000:
        raise ValueError(f"{n} boxes are too many to send to each task")
    inside = lambda x, y: F.col(x).between(F.col("west"), F.col("east")) & F.col(y).between(F.col("south"), F.col("north"))
    return requests.join(F.broadcast(boxes), inside("ox", "oy") & inside("dx", "dy")).groupBy("request_id").agg(F.min("box_id").alias("box_id"))
