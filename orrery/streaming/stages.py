"""Jobs that go through the stages: claimed under a lease, kept by heartbeats, tried again, given up.

Facts about a job (claimed, heartbeat, done, failed) come as events in time order.  A job
waits in a stage until it is claimed; a claim counts an attempt and holds for the lease, from
the last heartbeat of the worker that has it.  A lease that has run out, or a failure, puts the job
back into the queue (a failure after a delay that grows with its attempts), or makes it
failed when its attempts are used up.  Done, it queues in the next stage; after the last one it is done.

``staged`` folds a table of facts; ``stage_stream`` does the same over a stream, where
timers notice leases that run out while nothing happens.  Both give the same transitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scheduling import LEASE_SECONDS, RETRY_SECONDS, STAGES
from . import scans

MAX_ATTEMPTS = 3
QUEUED, RUNNING, DONE, FAILED = STATUS = "queued", "running", "done", "failed"
TRANSITION = "at double, stage string, status string, attempts int"


@dataclass
class Rules:
    lease: float = LEASE_SECONDS
    retry: float = RETRY_SECONDS
    max_attempts: int = MAX_ATTEMPTS


class Job:
    """One job's state; ``values`` is it as numbers: stage, status, attempts, lease's begin, its worker, when due."""

    def __init__(self, rules: Rules, values: list[float] | None = None):
        self.rules = rules
        stage, status, attempts, self.locked_at, worker, self.due = values or [0, 0, 0, 0, -1, float("-inf")]
        self.stage, self.status, self.attempts, self.worker = int(stage), int(status), int(attempts), int(worker)

    def values(self) -> list[float]:
        return [float(x) for x in (self.stage, self.status, self.attempts, self.locked_at, self.worker, self.due)]

    @property
    def running(self) -> bool:
        return STATUS[self.status] == RUNNING

    def seen(self, at: float) -> tuple:
        return at, STAGES[self.stage], STATUS[self.status], self.attempts

    def back(self, due: float) -> None:
        self.status = STATUS.index(FAILED if self.attempts >= self.rules.max_attempts else QUEUED)
        self.due = due

    def expire(self, now: float) -> list[tuple]:
        """The transition of a lease that has run out before ``now``."""
        end = self.locked_at + self.rules.lease
        if not self.running or end >= now:
            return []
        self.back(end)
        return [self.seen(end)]

    def event(self, kind: str, worker: int | None, at: float) -> list[tuple]:
        """Transitions up to and by an event; others than the known kinds, and those that do not fit the state, change nothing."""
        out = self.expire(at)
        if kind == "claimed" and STATUS[self.status] == QUEUED and self.due <= at:
            self.status, self.attempts, self.locked_at, self.worker = STATUS.index(RUNNING), self.attempts + 1, at, -1 if worker is None else int(worker)
        elif kind == "heartbeat" and self.running and worker is not None and int(worker) == self.worker:
            self.locked_at = at
            return out
        elif kind == "done" and self.running:
            if self.stage + 1 < len(STAGES):
                self.stage, self.status, self.attempts, self.due = self.stage + 1, STATUS.index(QUEUED), 0, at
            else:
                self.status = STATUS.index(DONE)
        elif kind == "failed" and self.running:
            self.back(at + self.rules.retry * self.attempts)
        else:
            return out
        return [*out, self.seen(at)]


def staged(facts: DataFrame, until: float | None = None, rules: Rules | None = None, parts: int | None = None) -> DataFrame:
    """``facts``: id, job, kind, worker, at (seconds).  (job, at, stage, status, attempts) of every transition, by leases that run out before ``until`` as well."""
    rules = rules or Rules()
    rows = facts.select("id", "job", "kind", F.col("worker").cast("long").alias("worker"), F.col("at").cast("double").alias("at"))
    if until is not None:  # a last event of no kind makes leases run out
        rows = rows.unionByName(facts.select("job").distinct().select(F.lit(None).cast("long").alias("id"), "job", F.lit("end").alias("kind"), F.lit(None).cast("long").alias("worker"), F.lit(until).cast("double").alias("at")))

    def step(values, row):
        job = Job(rules, values)
        worker = None if pd.isna(row.worker) else row.worker
        seen = job.event(row.kind, worker, row.at)
        return job.values(), (row.job, seen)

    kind = facts.schema["job"].dataType.simpleString()
    ranged = scans.ranged(rows.withColumn("last", F.col("kind") == "end"), ["job"], ["at", "last", "id"], parts)
    folded = scans.folded(ranged, "job", ["at", "last", "id"], f"job {kind}, seen array<struct<{TRANSITION}>>", scans.by_row(step))
    return folded.select("job", F.inline("seen"))


class StageProcessor(StatefulProcessor):
    """The state of a job in Spark's state store, with one timer: the end of its lease."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "values array<double>")

    def _job(self) -> Job:
        return Job(self.rules, list(self.state.get()[0]) if self.state.exists() else None)

    def _keep(self, job: Job) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.running:
            self.handle.registerTimer(int((job.locked_at + self.rules.lease) * 1000) + 1)
        self.state.update((job.values(),))

    def _rows(self, key: tuple, seen: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *s) for s in seen], columns=["job", "at", "stage", "status", "attempts"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job, seen = self._job(), []
        come = pd.concat(list(rows)).sort_values(["at", "id"])  # one batch's facts of one job
        for row in come.itertuples(index=False):
            seen += job.event(row.kind, None if pd.isna(row.worker) else row.worker, float(row.at))
        self._keep(job)
        yield self._rows(key, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._job()
        seen = job.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        if seen:
            self._keep(job)
        yield self._rows(key, seen)


def stage_stream(facts: DataFrame, rules: Rules | None = None, delay: str = "0 seconds") -> DataFrame:
    """Transitions over a stream of facts (as for ``staged``), each once; a job's facts must come in order, up to ``delay``.

    Needs the RocksDB state store provider.  A lease that runs out is told when the
    watermark passes its end.
    """
    kind = facts.schema["job"].dataType.simpleString()
    timed = facts.withColumn("seen_at", F.timestamp_seconds("at")).withWatermark("seen_at", delay)
    return timed.groupBy("job").transformWithStateInPandas(StageProcessor(rules or Rules()), f"job {kind}, {TRANSITION}", "Append", "EventTime")
