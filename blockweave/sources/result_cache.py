"""Cached results with an expiry: an index table and payloads."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TTL = {"network": 7 * 86400, "analysis": 86400, "search": 3600}
DEFAULT_TTL = 86400
SCHEMA = "cache_key string, cache_type string, params string, data string, created_at double, ttl_seconds long"


def key_of(cache_type: Column, params: Column) -> Column:
    return F.md5(F.concat_ws(":", cache_type, params).cast("binary"))


def expired(now: Column) -> Column:
    """An entry without a positive time to live never expires."""
    return (F.col("ttl_seconds") > 0) & (now > F.col("created_at") + F.col("ttl_seconds"))


def stats(index: DataFrame) -> DataFrame:
    """Entries, bytes and oldest entry by kind."""
    return index.groupBy("cache_type").agg(F.count("*").alias("entries"), F.sum(F.length("data")).alias("bytes"), F.min("created_at").alias("oldest"))


def live(index: DataFrame, now: Column) -> DataFrame:
    return index.where(~expired(now))


#: A line of the log: an entry, or a tombstone where gone is true; version orders the lines of a key.
LINE = SCHEMA + ", version long, gone boolean"
#: Tombstones stay in a compacted log for an hour, so that a line of another session which comes late stays covered.
KEEP_NS = 3600 * 10**9


def latest(lines: DataFrame) -> DataFrame:
    """The last line of each key, as entries: of lines of one version a tombstone counts, then the larger text."""
    order = F.struct("version", "gone", "data", *[c for c in lines.columns if c not in ("version", "gone", "data", "cache_key")])
    last = lines.groupBy("cache_key").agg(F.max(order).alias("m"))
    return last.select("cache_key", *[F.col("m")[c].alias(c) for c in lines.columns if c != "cache_key"])


class ResultCache:
    """A cache in a folder that all executors and sessions share, as a log of lines.

    Setting and removing append lines, each in a file that appears as a whole; nothing is
    rewritten.  Reading takes the last line of each key.  ``compact`` writes those lines as
    one table, publishes it by a rename, and removes the files that it has read; lines that
    come meanwhile stay, and a line read twice does no harm.
    """

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True):
        self.spark, self.folder, self.enabled = spark, folder, enabled
        self.hits, self.misses = 0, 0
        self._system = self._place(folder)[0]
        self._system.mkdirs(self._place(f"{folder}/log")[1])

    def _place(self, path: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _append(self, rows: DataFrame) -> None:
        rows.select(*[x.split()[0] for x in LINE.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def files(self) -> list[str]:
        """The files of the log."""
        return sorted(f.getPath().toString() for f in self._system.listStatus(self._place(f"{self.folder}/log")[1]) if f.getPath().getName().endswith(".parquet"))

    def lines(self) -> DataFrame:
        return self.spark.read.schema(LINE).parquet(f"{self.folder}/log")

    def table(self) -> DataFrame:
        """Entries that are there, expired ones too."""
        return latest(self.lines()).where("not gone").drop("version", "gone")

    @staticmethod
    def _params(params: dict) -> str:
        return json.dumps(params, sort_keys=True)

    def _named(self, cache_type: str, params: dict, data: Any = None, ttl: int = 0) -> DataFrame:
        new = self.spark.createDataFrame([(cache_type, self._params(params), json.dumps(data), time.time(), ttl, time.time_ns())], "cache_type string, params string, data string, created_at double, ttl_seconds long, version long")
        return new.select(key_of(F.col("cache_type"), F.col("params")).alias("cache_key"), *new.columns)

    def set(self, cache_type: str, params: dict, data: Any, ttl: int | None = None) -> bool:
        if not self.enabled:
            return False
        self._append(self._named(cache_type, params, data, TTL.get(cache_type, DEFAULT_TTL) if ttl is None else ttl).withColumn("gone", F.lit(False)))
        return True

    def get(self, cache_type: str, params: dict) -> Any | None:
        key = hashlib.md5(f"{cache_type}:{self._params(params)}".encode()).hexdigest()
        # The key reaches the scan, so other entries' texts aren't read.
        found = live(latest(self.lines().where(F.col("cache_key") == key)).where("not gone"), F.lit(time.time())).select("data").head() if self.enabled else None
        self.hits, self.misses = self.hits + bool(found), self.misses + (not found)
        return json.loads(found["data"]) if found else None

    def _bury(self, rows: DataFrame) -> int:
        """Tombstones for entries of the table; how many there are."""
        gone = rows.withColumns({"data": F.lit(None).cast("string"), "version": F.lit(time.time_ns()), "gone": F.lit(True)})
        n = gone.count()
        if n:
            self._append(gone)
        return n

    def invalidate(self, cache_type: str | None = None, params: dict | None = None) -> int:
        """Removes one entry, all of a kind, or all; a named entry counts as 1 even if there is none."""
        if cache_type and params:
            self._append(self._named(cache_type, params).withColumn("gone", F.lit(True)))
            return 1
        return self._bury(self.table().where(F.col("cache_type") == cache_type) if cache_type else self.table())

    def cleanup(self) -> int:
        return self._bury(self.table().where(expired(F.lit(time.time()))))

    def compact(self) -> int:
        """Makes one file of those that are there; how many there were."""
        old = self.files()
        if not old:
            return 0
        kept = latest(self.spark.read.schema(LINE).parquet(*old)).where(~F.col("gone") | (F.col("version") > time.time_ns() - KEEP_NS))
        new = f"{self.folder}/new-{uuid.uuid4().hex}"
        kept.select(*[x.split()[0] for x in LINE.split(", ")]).coalesce(1).write.parquet(new)
        for f in self._system.listStatus(self._place(new)[1]):
            if (name := f.getPath().getName()).endswith(".parquet"):
                self._system.rename(f.getPath(), self._place(f"{self.folder}/log/{name}")[1])
        self._system.delete(self._place(new)[1], True)
        for path in old:
            self._system.delete(self._place(path)[1], False)
        return len(old)

    def hit_rate(self) -> float:
        return round(self.hits / (self.hits + self.misses), 3) if self.hits + self.misses else 0.0
