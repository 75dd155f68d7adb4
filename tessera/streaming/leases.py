"""Leases of jobs as a stateful stream: claims, heartbeats, and what becomes of a job whose runner falls silent.

The state of a job is folded over its events in the order of their times; an event that comes at or after the end
of a lease finds the lease ended first, so the result does not depend on where micro-batches begin. A lease that
nobody speaks to any more ends by a timer when the watermark passes it. State and offsets are in the checkpoint:
a stream that is stopped anywhere goes on from there.

Defined cases: events of one time follow each other by ``seq``; rows without a job or a time are left out; what
is later than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States of a job; a finished one begins anew only by a claim after ``queued`` or ``interrupted``.
IDLE, RUNNING, CANCELLING = ("queued", "interrupted"), "running", "cancelling"
OUT = "job_id long, at_ms long, event string, verdict string, state string, epoch long, recoveries long"
STATE = "state string, epoch long, owner string, beat_ms long, until_ms long, saved boolean, recoveries long"


@dataclass
class Lease:
    state: str = "queued"
    epoch: int = 0
    owner: str | None = None
    beat_ms: int = 0
    until_ms: int = 0
    saved: bool = False
    recoveries: int = 0

    @property
    def live(self) -> bool:
        return self.state in (RUNNING, CANCELLING)

    def expire(self, at_ms: int) -> bool:
        """Ends a lease that is over: back to the queue from a checkpoint, else interrupted; a cancelled job is done."""
        if not self.live or at_ms < self.until_ms:
            return False
        self.state = "cancelled" if self.state == CANCELLING else "queued" if self.saved else "interrupted"
        self.owner, self.recoveries = None, self.recoveries + 1
        return True

    def apply(self, event: str, owner: str | None, at_ms: int, lease_ms: int) -> str:
        """``ok``, or why the event changes nothing."""
        if event == "claim":
            if self.state not in IDLE:
                return "invalid-transition"
            self.state, self.owner, self.epoch = RUNNING, owner, self.epoch + 1
            self.beat_ms, self.until_ms = at_ms, at_ms + lease_ms
            return "ok"
        if event == "cancel":
            if self.live:
                self.state = CANCELLING
                return "ok"
            if self.state in IDLE:
                self.state = "cancelled"
                return "ok"
            return "invalid-transition"
        if not self.live:
            return "invalid-transition"
        if owner != self.owner:
            return "lease-mismatch"
        if event == "heartbeat":
            if at_ms < self.beat_ms or at_ms + lease_ms <= self.until_ms:
                return "invalid-lease"
            self.beat_ms, self.until_ms = at_ms, at_ms + lease_ms
        elif event == "checkpoint":
            self.saved = True
        elif event == "finish":
            self.state, self.owner = "cancelled" if self.state == CANCELLING else "succeeded", None
        else:
            return "unknown-event"
        return "ok"


def fold(lease: Lease, events: list[tuple], lease_ms: int) -> list[tuple]:
    """Output rows of a job's (at_ms, seq, event, owner), in order; ends of leases come in between."""
    out = []
    for at_ms, _, event, owner in sorted(events, key=lambda e: (e[0], e[1])):
        if lease.expire(at_ms):
            out.append((lease.until_ms, "expire", "ok", lease.state, lease.epoch, lease.recoveries))
        verdict = lease.apply(event, owner, at_ms, lease_ms)
        out.append((at_ms, event, verdict, lease.state, lease.epoch, lease.recoveries))
    return out


def lease_events(events: DataFrame, lease_ms: int = 30_000, late: str = "10 seconds") -> DataFrame:
    """One row an event and end of a lease, of a stream of (job_id, seq, ts, event, owner)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease = Lease(*state.get) if state.exists else Lease()
        if state.hasTimedOut:
            rows = [(lease.until_ms, "expire", "ok", lease.state, lease.epoch, lease.recoveries)] if lease.expire(state.getCurrentWatermarkMs()) else []
        else:
            got = [(int(t.timestamp() * 1000), int(q), e, o) for b in batches for t, q, e, o in zip(b["ts"], b["seq"], b["event"], b["owner"])]
            rows = fold(lease, got, lease_ms)
        state.update((lease.state, lease.epoch, lease.owner, lease.beat_ms, lease.until_ms, lease.saved, lease.recoveries))
        if lease.live:  # the timer stands at the end of the lease, or at once where the watermark is past it
            state.setTimeoutTimestamp(max(lease.until_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])

    clean = events.filter("job_id is not null and ts is not null").select("job_id", "seq", "ts", "event", "owner")
    return clean.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
