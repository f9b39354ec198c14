"""Runs of traffic on roads as a stream's own state, with timers, and progress events of streams.

A run is a road's events without a longer gap.  In a stream a road's open runs are its
state: events extend or join them in whatever order they come, and a timer of event time
ends a run once the watermark has passed its last event by the gap.  It is given out then,
and a road without an open run has no state left.  Events behind the watermark are dropped
by Spark.  On a table the same runs come from spans of time as wide as the gap: a road's
events in one span are one run, so they are counted first, and only spans, of which a road
has few a day however many events it has, are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Vehicles that an event stands for.
VEHICLES = 37
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "osmid long, first_us long, last_us long, vehicles long"


class OpenRuns(StatefulProcessor):
    """Open runs (first and last event in microseconds, number of events) of a road."""

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long, n long")

    def _ends(self, last: int) -> int:
        """The millisecond from which on no event can extend a run."""
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(map(int, r)) for r in self.runs.get()]
        new = [(t, t, n) for pdf in rows for t, n in pdf.groupby("us").size().items()]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(old + [tuple(map(int, r)) for r in new]):
            if merged and first - merged[-1][1] <= self.gap:
                a, b, m = merged[-1]
                merged[-1] = (a, max(b, last), m + n)
            else:
                merged.append((first, last, n))
        before, after = {self._ends(r[1]) for r in old}, {self._ends(r[1]) for r in merged}
        for t in before - after:
            self.handle.deleteTimer(t)
        for t in after - before:
            self.handle.registerTimer(t)
        self.runs.put(merged)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        runs = [tuple(map(int, r)) for r in self.runs.get()]
        over, still = [r for r in runs if self._ends(r[1]) <= at], [r for r in runs if self._ends(r[1]) > at]
        if still:
            self.runs.put(still)
        else:
            self.runs.clear()
        if over:
            yield pd.DataFrame({"osmid": key[0], "first_us": [r[0] for r in over], "last_us": [r[1] for r in over], "vehicles": [r[2] * VEHICLES for r in over]})

    def close(self) -> None:
        pass


def road_runs(events: DataFrame, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(osmid, first_event, last_event, vehicles) of runs of events (user_id, ts) of a road, none more than the gap after the one before.

    Events without a road or a time are left out.  A stream gives each run once, in append
    mode, and needs a state store with timers, which is set for the session.
    """
    e = events.where("user_id is not null and ts is not null").select((F.col("user_id") * 4).alias("osmid"), F.col("ts").cast("timestamp").alias("ts"))
    gap = gap_minutes * 60_000_000
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    if not events.isStreaming:
        us = F.col("us")
        t = e.select("osmid", F.unix_micros("ts").alias("us"))
        t = t.groupBy("osmid", (us - F.pmod(us, F.lit(gap))).alias("span")).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))
        by = W.partitionBy("osmid").orderBy("span")
        t = t.withColumn("new", F.coalesce((F.col("first_us") - F.lag("last_us").over(by) > gap).cast("long"), F.lit(1)))
        t = t.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
        g = t.groupBy("osmid", "run").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), (F.sum("n") * VEHICLES).alias("vehicles"))
    else:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        t = e.withWatermark("ts", late).select("osmid", "ts", F.unix_micros("ts").alias("us"))
        g = t.groupBy("osmid").transformWithStateInPandas(OpenRuns(gap), RUN, "Append", "EventTime")
    return g.select("osmid", moment(F.col("first_us")).alias("first_event"), moment(F.col("last_us")).alias("last_event"), "vehicles")


class ProgressListener(StreamingQueryListener):
    """Sends an event to a function for what happens to one named stream, in the form of an analysis's progress.

    With the number of rows that are to come, events say what share is done; without it 0
    until the end.
    """

    def __init__(self, name: str, send: Callable[[dict], None], expected: int | None = None) -> None:
        self.name, self.send, self.expected = name, send, expected
        self.run, self.rows = None, 0

    def _event(self, kind: str, percent: int, message: str) -> None:
        self.send({"type": kind, "stage": self.name, "percent": percent, "message": message})

    def _percent(self) -> int:
        return min(99, 100 * self.rows // self.expected) if self.expected else 0

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId
            self._event("progress", 0, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId == self.run:
            self.rows += p.numInputRows
            held = sum(s.numRowsTotal for s in p.stateOperators)
            self._event("progress", self._percent(), f"batch {p.batchId}: {p.numInputRows} rows, {held} in state")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            failed = event.exception
            self._event("error" if failed else "complete", self._percent() if failed else 100, failed or "done")
