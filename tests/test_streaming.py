"""Streaming twins on several files: state across micro-batches and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from tracewell.streaming import monitor
from tracewell.streaming.lateness import split_late
from tracewell.streaming.replay import rocksdb


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, "k int, ts timestamp, x double").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_run_state_crosses_batches(spark, tmp_path):
    for i, values in enumerate(([9.0, 1.0], [1.0, 1.0], [0.0, 9.0])):
        write(spark, tmp_path, f"in/b{i}", [(1, at(2 * i + j), v) for j, v in enumerate(values)])
    stream = spark.readStream.schema("k int, ts timestamp, x double").option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = monitor.sustained_alarms(stream, "k", "ts", F.col("x") < 5, 4, "1 hour")
    with rocksdb(spark):
        q = out.writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("runs").collect()
    assert [(r["k"], r["start"], r["confirmed"]) for r in rows] == [(1, at(1), at(4))]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    write(spark, tmp_path, "in/b0", [(1, at(0), 1.0), (1, at(600), 2.0)])
    q = None
    for step in range(2):
        if step:
            write(spark, tmp_path, "in/b1", [(1, at(5), 99.0), (1, at(900), 3.0)])
        stream = spark.readStream.schema("k int, ts timestamp, x double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        windows = monitor.tumbling_windows(stream, "ts", ["k"], "10 minutes", "1 minute", "x")
        q = windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option(
            "path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert monitor.dropped_by_watermark(q) == 1
    got = {r["start"]: r["peak"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[at(0)] == 1.0 and 99.0 not in got.values()


def replayed(spark, tmp_path, name, files, build):
    """Rows of a stateful stream over files that come one after the other."""
    for i, rows in enumerate(files):
        write(spark, tmp_path, f"{name}/b{i}", rows)
    stream = spark.readStream.schema("k int, ts timestamp, x double").option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(tmp_path / name))
    with rocksdb(spark):
        q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, sorted(map(tuple, spark.table(name).collect()))


def test_silent_keys_are_forgotten(spark, tmp_path):
    """Key 1 is silent for two days while key 2 moves the clock: its anchor and its report are gone when it comes back."""
    day = 24 * 60
    files = [[(1, at(0), 5.0), (1, at(1), 6.0), (2, at(2), 1.0)], [(2, at(2 * day), 2.0)], [(2, at(2 * day + 5), 2.0)],
             [(1, at(2 * day + 10), 8.0), (1, at(2 * day + 11), 9.5)]]
    _, got = replayed(spark, tmp_path, "anchored", files, lambda s: monitor.anchored_residuals(s, "k", "ts", "x", 1, "1 hour", keep="1 day"))
    assert [r for r in got if r[0] == 1] == [(1, at(1), 1.0), (1, at(2 * day + 11), 1.5)]
    _, kept = replayed(spark, tmp_path, "anchored_long", files, lambda s: monitor.anchored_residuals(s, "k", "ts", "x", 1, "1 hour"))
    assert [r for r in kept if r[0] == 1] == [(1, at(1), 1.0), (1, at(2 * day + 10), 3.0), (1, at(2 * day + 11), 4.5)]
    _, again = replayed(spark, tmp_path, "alarms", files, lambda s: monitor.sustained_alarms(s, "k", "ts", F.col("x") > 4, 2, "1 hour", keep="1 day"))
    assert [r[0] for r in again] == [1, 1]


def test_stateful_streams_drop_late_rows(spark, tmp_path):
    files = [[(1, at(0), 9.0), (1, at(600), 9.0)], [(1, at(601), 1.0)], [(1, at(5), 9.0), (1, at(602), 9.0), (1, at(603), 9.0)]]
    q, got = replayed(spark, tmp_path, "late_alarms", files, lambda s: monitor.sustained_alarms(s, "k", "ts", F.col("x") > 4, 2, "1 minute"))
    assert got == [(1, at(0), at(600))] and monitor.dropped_by_watermark(q) == 1


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    files = [[(1, at(0), 1.0), (1, at(600), 2.0)], [(1, at(5), 3.0), (2, at(599), 4.0), (2, None, 5.0), (1, at(900), 6.0)], [(3, at(700), 7.0)]]
    for i, rows in enumerate(files):
        write(spark, tmp_path, f"in/b{i}", rows)
        stream = spark.readStream.schema("k int, ts timestamp, x double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        in_time, late = split_late(stream, "ts", "1 minute", str(tmp_path / "split"))
    assert sorted(r["x"] for r in in_time.collect()) == [1.0, 2.0, 4.0, 5.0, 6.0]
    assert sorted((r["x"], r["watermark"], r["batch"]) for r in late.collect()) == [(3.0, at(599), 1), (7.0, at(899), 2)]
