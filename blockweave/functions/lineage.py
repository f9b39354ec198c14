"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    A folder of our own is set only where a local session has none, as in tests; on a
    cluster a missing setting is an error, as the executors share no temporary folder.
    What is written there goes when the driver ends.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    own = f"{sc._jsc.sc().getCheckpointDir().get()}/written"
    if own not in _written:
        _written.add(own)
        atexit.register(_at_end, *_place(spark, own))
    return own


_written: set[str] = set()


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _at_end(system, place) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        system.delete(place, True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reads."""
    system, place = _place(spark, path)
    system.delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """A table in the shared folder, written and read again: unlike a checkpoint it carries nothing of its plan, which would grow from round to round."""
    path = f"{checkpoint_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
