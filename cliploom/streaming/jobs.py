"""The state of each job of a queue, from a stream of what happens to it: attempts, deadlines, stalled jobs.

Each job is a key with state of its own. What happens to it waits until the watermark has passed, and is then taken in
order of time, so the result does not depend on how events are dealt to micro-batches. A running job that gives no sign for
`stall` ms stalls at that moment, found by a timer if nothing else happens; a failed or stalled job goes back to the queue
until it has had `most` attempts, then it is dead. Finished jobs are forgotten after `keep` ms, so state does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ensure_importable

EVENTS = "job_id long, at timestamp, kind string"
CHANGES = "job_id long, at timestamp, status string, attempt long"
#: Milliseconds without a sign, most attempts, milliseconds for which a finished job is remembered.
STALL, MOST, KEEP = 12 * 3_600_000, 3, 7 * 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

State = tuple[str, int, int]
NEW: State = ("", 0, 0)
#: Order of what happens at one moment.
ORDER = {"submitted": 0, "started": 1, "beat": 2, "failed": 3, "done": 4}


def stalled(state: State, at: int, most: int) -> tuple[State, list[tuple[int, str, int]]]:
    """The state at a moment, once a deadline before or at it has been missed."""
    status, attempt, due = state
    if status != "running" or due > at:
        return state, []
    back = attempt < most
    changes = [(due, "stalled", attempt), (due, "queued" if back else "dead", attempt)]
    return ("queued" if back else "dead", attempt, due), changes


def step(state: State, at: int, kind: str, stall: int = STALL, most: int = MOST) -> tuple[State, list[tuple[int, str, int]]]:
    """The state after something happened, and the changes (at, status, attempt); what does not fit the state changes nothing."""
    (status, attempt, due), changes = stalled(state, at, most)
    if kind == "submitted" and status in ("", "done", "dead"):
        return ("queued", 0, at), [*changes, (at, "queued", 0)]
    if kind == "started" and status == "queued":
        return ("running", attempt + 1, at + stall), [*changes, (at, "running", attempt + 1)]
    if status == "running":
        if kind == "beat":
            due = at + stall
        elif kind == "done":
            return ("done", attempt, at), [*changes, (at, "done", attempt)]
        elif kind == "failed":
            after = "queued" if attempt < most else "dead"
            return (after, attempt, at), [*changes, (at, "failed", attempt), (at, after, attempt)]
    return (status, attempt, due), changes


class Tracker(StatefulProcessor):
    """Keeps a job's state and what has happened to it since the watermark."""

    def __init__(self, stall: int, most: int, keep: int) -> None:
        self.stall, self.most, self.keep = stall, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempt long, due long")
        self.waiting = handle.getListState("waiting", "at long, kind string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """One timer for all that came, at its first moment: what expires takes everything up to the watermark and sets the next."""
        first: list[int] = []
        for part in rows:
            at = part["at"].astype("datetime64[ms]").astype("int64").tolist()
            self.waiting.appendList(list(zip(at, part["kind"].tolist(), strict=True)))
            first = [min([*at, *first])] if at else first
        for x in first:
            self.handle.registerTimer(x)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state = tuple(self.job.get()) if self.job.exists() else NEW
        happened, later, changes = [], [], []
        for at, kind in self.waiting.get() if self.waiting.exists() else ():
            (happened if at <= now else later).append((at, kind))
        for at, kind in sorted(happened, key=lambda x: (x[0], ORDER.get(x[1], 9), x[1])):
            state, more = step(state, at, kind, self.stall, self.most)
            changes += more
        state, more = stalled(state, now, self.most)
        changes += more
        status, _, due = state
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
            self.handle.registerTimer(min(x[0] for x in later))
        if status in ("done", "dead") and due + self.keep <= now or status == "":
            self.job.clear()
        else:
            self.job.update(state)
            if status == "running":
                self.handle.registerTimer(due)
            elif status != "queued":
                self.handle.registerTimer(due + self.keep)
        if changes:
            yield pd.DataFrame({"job_id": [key[0]] * len(changes), "at": pd.to_datetime([c[0] for c in changes], unit="ms"), "status": [c[1] for c in changes], "attempt": [c[2] for c in changes]})

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "1 hour", stall: int = STALL, most: int = MOST, keep: int = KEEP) -> DataFrame:
    """A stream of changes (job_id, at, status, attempt) of a stream of events (job_id, at, kind), in append mode.

    kind is submitted, started, beat, done or failed. Events later than `late` are dropped by the watermark; rows with nulls
    are ignored. The session's state store must be RocksDB (`ROCKS`).
    """
    known = events.where("job_id is not null and kind is not null").withWatermark("at", late)
    return known.groupBy("job_id").transformWithStateInPandas(Tracker(stall, most, keep), CHANGES, "append", "eventTime")


def run(events: DataFrame, path: str, checkpoint: str, **limits: Any) -> None:
    """Take all events there are now and append changes to the Parquet folder `path`; the next call goes on from there."""
    ensure_importable(events.sparkSession)
    conf = events.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass", None)
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = changes(events, **limits).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else conf.set("spark.sql.streaming.stateStore.providerClass", before)
