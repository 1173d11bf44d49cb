"""States of background jobs: pending, queued after a timeout, completed or failed (late where queued), expired.

The same transitions come as a stream, with a state and timers of event time for
each job, and from a table, as windows over the events of a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: How long a request waits for its result, and how long a job is kept after its last change, in milliseconds.
TIMEOUT_MS, KEPT_MS = 12_000, 86_400_000
#: Kinds of events: a job is handed in, or its result comes.
SUBMIT, DONE, FAILED = "submit", "done", "failed"
TRANSITION = "job_id string, status string, late boolean, at_ms long"


class JobStates(StatefulProcessor):
    """One job: (phase, when it last changed); timers stand at its next change that needs no event."""

    def __init__(self, timeout_ms: int = TIMEOUT_MS, kept_ms: int = KEPT_MS):
        self.timeout_ms, self.kept_ms = timeout_ms, kept_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "phase string, changed_ms long")

    def _due(self, until: int) -> list[tuple[str, bool, int]]:
        """What happened by itself up to a time: the timeout, then the end."""
        out = []
        if self.state.exists() and (now := self.state.get())[0] == "pending" and now[1] + self.timeout_ms <= until:
            out.append(("queued", False, now[1] + self.timeout_ms))
            self.state.update(("queued", now[1]))
        if self.state.exists() and (end := self.state.get()[1] + self.kept_ms) <= until:
            out.append(("expired", False, end))
            self.state.clear()
        return out

    def _wait(self) -> None:
        if self.state.exists():
            phase, changed = self.state.get()
            self.handle.registerTimer(changed + (self.timeout_ms if phase == "pending" else self.kept_ms))

    def _rows(self, key: tuple, found: list[tuple[str, bool, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *f) for f in found], columns=["job_id", "status", "late", "at_ms"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        events = pd.concat(list(rows)).sort_values(["at_ms", "kind"], ascending=[True, False])
        for at, kind in zip(events["at_ms"].tolist(), events["kind"].tolist(), strict=True):
            found += self._due(at)
            phase = self.state.get()[0] if self.state.exists() else None
            if kind == SUBMIT and phase is None:
                found.append(("pending", False, at))
                self.state.update(("pending", at))
            elif kind != SUBMIT and phase in ("pending", "queued"):
                found.append(("completed" if kind == DONE else "failed", phase == "queued", at))
                self.state.update(("finished", at))
        self._wait()
        yield self._rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed: a timer set now might find no later batch.
        found = self._due(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._wait()
        yield self._rows(key, found)

    def close(self) -> None:
        pass


def stream_transitions(events: DataFrame, timeout_ms: int = TIMEOUT_MS, kept_ms: int = KEPT_MS, delay: str = "0 seconds") -> DataFrame:
    """Transitions of a stream of events (job_id, kind, ts).

    Needs the RocksDB state store.  Changes that need no event come when the
    watermark has passed them; a job's events of one batch are taken in order,
    those that are later than `delay` are not seen.
    """
    timed = events.select("job_id", "kind", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay).withColumn("at_ms", F.unix_millis("ts"))
    states = JobStates(timeout_ms, kept_ms)
    return timed.groupBy("job_id").transformWithStateInPandas(statefulProcessor=states, outputStructType=TRANSITION, outputMode="Append", timeMode="EventTime")


def transitions(events: DataFrame, timeout_ms: int = TIMEOUT_MS, kept_ms: int = KEPT_MS, until_ms: Column | None = None) -> DataFrame:
    """Transitions of a table of events (job_id, kind, ts), up to `until_ms` or the last event.

    A job has one submission that counts, its first, and one result, the first
    behind it that comes before the job expires; a job's events are few, so the
    window of a job is small however many jobs there are.
    """
    timed = events.select("job_id", "kind", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    last = timed.agg(F.max("at_ms").alias("until_ms")) if until_ms is None else timed.sparkSession.range(1).select(until_ms.cast("long").alias("until_ms"))
    job = Window.partitionBy("job_id")
    started = timed.withColumn("start", F.min(F.when(F.col("kind") == SUBMIT, F.col("at_ms"))).over(job))
    answer = (F.col("kind") != SUBMIT) & (F.col("at_ms") >= F.col("start")) & (F.col("at_ms") < F.col("start") + kept_ms)
    jobs = started.where("start IS NOT NULL").groupBy("job_id", "start").agg(F.min(F.when(answer, F.struct("at_ms", F.when(F.col("kind") == DONE, "completed").otherwise("failed").alias("status")))).alias("result"))
    result = F.col("result.at_ms")
    queued = F.coalesce(result >= F.col("start") + timeout_ms, F.lit(True))
    end = F.coalesce(result, F.col("start")) + kept_ms
    step = lambda status, late, at, when=None: F.when(F.lit(True) if when is None else when, F.struct(status.alias("status"), late.alias("late"), at.cast("long").alias("at_ms")))
    no = F.lit(False)
    steps = F.array_compact(F.array(
        step(F.lit("pending"), no, F.col("start")),
        step(F.lit("queued"), no, F.col("start") + timeout_ms, queued & (F.col("start") + timeout_ms <= F.col("until_ms"))),
        step(F.col("result.status"), queued, result, result.isNotNull()),
        step(F.lit("expired"), no, end, end <= F.col("until_ms")),
    ))
    # One row, so it is sent to all.
    return jobs.crossJoin(F.broadcast(last)).select("job_id", F.explode(steps).alias("x")).select("job_id", "x.*")
