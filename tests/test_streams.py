"""Streams over files: windows, late rows, polling state, de-duplication and bursts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.streaming import streams

EVENT = "id long, version long, ts timestamp, event_type string, value double, path string"


@pytest.fixture
def folder(tmp_path):
    return tmp_path / "in"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def drain(df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(minute, hour=0):
    return (dt.datetime(2024, 1, 1, hour) + dt.timedelta(minutes=minute)).isoformat() + "Z"


def test_windows_agree_with_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = streams.follow(spark, str(tmp_path / "in"), events.schema)
    got = drain(streams.hourly_counts(stream, late="60 days"), tmp_path, "complete")
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r["w"]["start"], r["event_type"], r["n"]) for r in got} == {(r["w"]["start"], r["event_type"], r["n"]) for r in want}


def test_polling_state(spark, folder, tmp_path):
    for i, rows in enumerate([[(1, 1), (2, 1)], [(1, 2), (2, 1)], [(1, 1), (3, 5)]]):
        put(folder, f"{i}.json", [{"id": a, "version": b} for a, b in rows])
    stream = streams.follow(spark, str(folder), EVENT, files_at_once=1)
    got = drain(streams.poll_changes(stream.select("id", "version")), tmp_path, "append")
    seen = {(r["id"], r["kind"], r["version"]) for r in got}
    assert {(2, "created", 1), (3, "created", 5)} <= seen and all(k in ("created", "changed") for _, k, _ in seen)


def test_same_version_passes_once(spark, folder, tmp_path):
    put(folder, "a.json", [{"id": 1, "version": 1, "ts": at(0)}, {"id": 1, "version": 1, "ts": at(0)}, {"id": 1, "version": 2, "ts": at(1)}])
    got = drain(streams.once_per_version(streams.follow(spark, str(folder), EVENT)).select("id", "version"), tmp_path)
    assert sorted((r["id"], r["version"]) for r in got) == [(1, 1), (1, 2)]


def test_bursts(spark, folder, tmp_path):
    put(folder, "a.json", [{"path": "x", "ts": "2024-01-01T00:00:00.000Z"}, {"path": "x", "ts": "2024-01-01T00:00:00.300Z"}, {"path": "x", "ts": "2024-01-01T00:00:02.000Z"}])
    got = drain(streams.debounced(streams.follow(spark, str(folder), EVENT)), tmp_path, "complete")
    assert sorted(r["changes"] for r in got) == [1, 2]


def test_webhook_filter(spark):
    df = spark.createDataFrame([("A", "issue"), ("B", "issue"), ("A", "page")], "project string, kind string")
    assert streams.webhook_events(df, ["A"], ["issue"]).count() == 1
