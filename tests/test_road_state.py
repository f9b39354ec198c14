"""Runs of roads: stream against table over a restart, and progress events of streams."""

import time
from datetime import datetime, timedelta

from blockweave.operators import display
from blockweave.streaming import road_state

START = datetime(2024, 5, 1, 12)


def write(spark, folder, name, rows):
    rows = [(user, None if m is None else START + timedelta(minutes=m), "x") for user, m in rows]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, osmid string").coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp_path, name, listener=None):
    schema = "user_id long, ts timestamp_ntz, osmid string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    if listener:
        spark.streams.addListener(listener)
    q = road_state.road_runs(events).writeStream.queryName(name).outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])


#: Minutes of events by file: 1 has a run over a restart and another one, 2 one that a late event joins, just the gap after the first, 3 one that ends; the last events only move the watermark.
FILES = [[(1, 0), (1, 0), (1, 20), (2, 10), (3, 5), (None, 3), (4, None)], [(2, 50), (1, 45), (2, 40)], [(1, 70), (2, 70), (1, 130)], [(9, 600)], [(9, 601)]]


def test_stream_over_a_restart_equals_table(spark, tmp_path):
    seen = []
    for k, rows in enumerate(FILES[:2]):
        write(spark, f"{tmp_path}/in", f"f{k}", rows)
    run(spark, tmp_path, "first")
    for k, rows in enumerate(FILES[2:], 2):
        write(spark, f"{tmp_path}/in", f"f{k}", rows)
    listener = road_state.ProgressListener("second", seen.append, expected=5)
    held = run(spark, tmp_path, "second", listener)
    table = road_state.road_runs(spark.read.parquet(f"{tmp_path}/in/*"))
    want = {tuple(r) for r in table.collect() if r.osmid != 36}
    minute = lambda m: START + timedelta(minutes=m)
    assert want == {(4, minute(0), minute(70), 37 * 5), (4, minute(130), minute(130), 37), (8, minute(10), minute(70), 37 * 4), (12, minute(5), minute(5), 37)}
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, out)) == sorted(want)
    # Only the last road, whose run is open, still has a state: its run and its timer.
    assert 1 <= held <= 4
    deadline = time.time() + 20
    while time.time() < deadline and not (seen and seen[-1]["type"] == "complete"):
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert seen[0]["type"] == "progress" and seen[-1] == {"type": "complete", "stage": "second", "percent": 100, "message": "done"}
    percents = [e["percent"] for e in seen]
    assert percents == sorted(percents) and any("in state" in e["message"] for e in seen)
    texts = display.event_text(spark.createDataFrame(seen, "type string, stage string, percent int, message string"))
    assert display.parse_events(texts).count() == len(seen)


def test_runs_across_spans(spark):
    """Before and after 1970, just the gap apart and a microsecond more, repeated."""
    epoch, gap = datetime(1970, 1, 1), timedelta(minutes=30)
    us = timedelta(microseconds=1)
    times = [epoch - gap, epoch - gap, epoch, epoch + gap + us, epoch + 2 * gap + us, epoch + 2 * gap + us, epoch - 2 * gap - us]
    rows = road_state.road_runs(spark.createDataFrame([(1, t) for t in times], "user_id long, ts timestamp_ntz")).collect()
    want = [(epoch - 2 * gap - us, epoch - 2 * gap - us, 37), (epoch - gap, epoch, 37 * 3), (epoch + gap + us, epoch + 2 * gap + us, 37 * 3)]
    assert sorted((r.first_event, r.last_event, r.vehicles) for r in rows) == want


def test_tables_without_runs(spark):
    empty = spark.createDataFrame([], "user_id long, ts timestamp_ntz")
    assert road_state.road_runs(empty).count() == 0
    assert road_state.road_runs(spark.createDataFrame([(None, START), (1, None)], empty.schema)).count() == 0
