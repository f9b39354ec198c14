"""Real traffic counts as a stream: windows over events, joined with roads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, pattern: str = "events.parquet") -> DataFrame:
    """A stream of the event files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event times as instants, which watermarks need; late events wait only in a stream."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withWatermark("ts", late) if events.isStreaming else t


def hourly_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """osmid, window start and vehicles; the same plan on a stream and on a table."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events, late).groupBy(w.alias("w"), (F.col("user_id") * 4).alias("osmid")).agg((F.count("*") * 37).alias("volume")).select("osmid", F.col("w.start").cast("timestamp_ntz").alias("start"), "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of one road without a longer gap."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), (F.col("user_id") * 4).alias("osmid")).agg(F.count("*").alias("n")).select("osmid", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def run_to_table(counts: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming plan over all that is there now, into a table in memory."""
    query = counts.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)


def running_load(events: DataFrame) -> DataFrame:
    """(osmid, vehicles) after each batch for the roads that had events in it: totals are the stream's state."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (total,) = state.get if state.exists else (0,)
        total += 37 * sum(len(b) for b in batches)
        state.update((total,))
        yield pd.DataFrame({"osmid": [key[0]], "vehicles": [total]})

    roads = events.select((F.col("user_id") * 4).alias("osmid"), F.lit(1).alias("one"))
    return roads.groupBy("osmid").applyInPandasWithState(add, "osmid long, vehicles long", "total long", "update", GroupStateTimeout.NoTimeout)


def progress(stages: list[tuple[str, Callable[[], object]]], guess: float = 90.0) -> Iterator[dict]:
    """Runs stages in turn and yields an event before each, with the share done and the seconds that remain; a failure ends with an error event."""
    began = time.monotonic()
    for k, (name, run) in enumerate(stages):
        percent, elapsed = 100 * k // len(stages), time.monotonic() - began
        left = guess if not percent else max(0.0, elapsed / (percent / 100) - elapsed)
        yield {"type": "progress", "stage": name, "percent": percent, "message": f"{name} ({k + 1}/{len(stages)})", "remaining": left}
        try:
            run()
        except Exception as e:
            yield {"type": "error", "stage": name, "percent": percent, "message": str(e)}
            return
    yield {"type": "complete", "stage": "complete", "percent": 100, "message": "done"}
