"""Streams of events and logs: polling state, windows with late data, follow-up joins, leases, log tails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def follow(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json", files_at_once: int = 16) -> DataFrame:
    """New files of a folder as a stream; a bounded number of files a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(kind).load(path)


def hourly_counts(events: DataFrame, late: str = "2 hours", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; rows later than ``late`` behind the newest are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def debounced(events: DataFrame, key: str = "path", gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row a burst of changes of a key: changes closer than ``gap`` belong together."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("changes"))


def once_per_version(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Re-read rows of the same id and version pass once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "version"])


def webhook_events(events: DataFrame, projects: list[str] = (), kinds: list[str] = ()) -> DataFrame:
    out = events
    if projects:
        out = out.filter(F.col("project").isin(list(projects)))
    return out.filter(F.col("kind").isin(list(kinds))) if kinds else out


def purchases_after_clicks(clicks: DataFrame, purchases: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each purchase with the clicks of its user in the time before; both sides forget what is too old."""
    a = clicks.withWatermark("ts", within).select(F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts"))
    b = purchases.withWatermark("ts", within)
    return b.join(a, F.expr(f"user_id = click_user and click_ts <= ts and click_ts >= ts - interval {within}"))


def poll_changes(snapshots: DataFrame) -> DataFrame:
    """(id, kind, version) of a stream of (id, version) rows: created at first sight, changed at each greater version."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        out = []
        for version in sorted(v for b in batches for v in b["version"]):
            if known is None or version > known:
                out.append((key[0], "created" if known is None else "changed", int(version)))
                known = int(version)
        state.update((known,))
        yield pd.DataFrame(out, columns=["id", "kind", "version"])

    return snapshots.groupBy("id").applyInPandasWithState(step, "id long, kind string, version long", "version long", "append", GroupStateTimeout.NoTimeout)


def lease_states(heartbeats: DataFrame, timeout_ms: int = 30_000, late: str = "10 seconds") -> DataFrame:
    """(job_id, state): running at each first heartbeat, expired when none follows within the time-out of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "state": ["expired"]})
            return
        newest = max(t for b in batches for t in b["ts"])
        if not state.exists:
            yield pd.DataFrame({"job_id": [key[0]], "state": ["running"]})
        state.update((int(newest.timestamp() * 1000),))
        state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + timeout_ms, state.getCurrentWatermarkMs() + 1))

    return heartbeats.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, "job_id long, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_each_batch(events: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``merge`` on each micro-batch; offsets in ``checkpoint`` make it at least once, keys make it idempotent."""
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
