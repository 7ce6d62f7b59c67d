"""Ordered folds over events, in batch and as streams.

In batch, a key of any size spreads over ranges (``scans``).  The stream versions
keep the same state in Spark's state store.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scheduling
from ..sources.scratch import written
from . import scans

LIMIT, WINDOW_SECONDS, FANOUT, PARTS, HEARTBEAT_SECONDS = 120, 60.0, 200, 16, 15.0


class Limiter:
    """Sliding window of accepted hits; rejected ones are not recorded."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW_SECONDS, hits: list[float] | None = None):
        self.limit, self.window, self.hits = limit, window, deque(hits or [])

    def hit(self, now: float) -> tuple[bool, int]:
        """(accepted, seconds to wait)."""
        while self.hits and self.hits[0] <= now - self.window:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return False, max(1, math.ceil(self.hits[0] + self.window - now))
        self.hits.append(now)
        return True, 0

    def run(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``hit`` of each of ascending times: the work follows the accepted ones, what is rejected between two of them is found by bisection."""
        if np.isnan(times).any():
            got = [self.hit(t) for t in times.tolist()]
            return np.array([a for a, _ in got]), np.array([w for _, w in got])
        accepted, wait = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
        since = times - self.window  # hits up to here are out of the window
        i = 0
        while i < len(times):
            while self.hits and self.hits[0] <= since[i]:
                self.hits.popleft()
            if len(self.hits) < self.limit:
                accepted[i] = True
                self.hits.append(float(times[i]))
                i += 1
            else:
                end = i + int(np.searchsorted(since[i:], self.hits[0]))
                wait[i:end] = np.maximum(1, np.ceil(self.hits[0] + self.window - times[i:end]))
                i = end
        return accepted, wait


class Incident:
    """States of an incident's usages with running counts."""

    AFTER = {"usage_found": "pending", "patch_generated": "pending", "patch_failed": "failed", "validation_passed": "verified", "validation_failed": "failed"}

    def __init__(self):
        self.nodes: dict[object, str] = {}
        self.active = self.resolved = 0

    def event(self, kind: str, usage: object) -> tuple[int, int]:
        """(active, resolved) after the event; a second sighting of a usage does not count, active never falls below 0."""
        if kind == "pr_opened":
            for key, state in self.nodes.items():
                if state == "verified":
                    self.nodes[key] = "resolved"
                    self.active, self.resolved = max(0, self.active - 1), self.resolved + 1
        elif kind in self.AFTER and usage is not None:
            if kind == "usage_found" and usage not in self.nodes:
                self.active += 1
            if usage in self.nodes or kind == "usage_found":
                self.nodes[usage] = self.AFTER[kind]
        return self.active, self.resolved


def rate_limited(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS, parts: int | None = None) -> DataFrame:
    """``hits``: id, client, ts (seconds).  (id, client, accepted, retry_after).

    Ranges of (client, ts) are folded side by side, a client of any size over
    many of them; what a range passes on is at most ``limit`` times.
    """

    def step(times, columns):
        limiter = Limiter(limit, window, times)
        given = limiter.run(columns["ts"])
        return list(limiter.hits), [columns["id"], columns["client"], *given]

    kind = hits.schema["client"].dataType.simpleString()
    rows = scans.ranged(hits.select("id", "client", F.col("ts").cast("double").alias("ts")), ["client"], ["ts", "id"], parts)
    return scans.folded(rows, "client", ["ts", "id"], f"id long, client {kind}, accepted boolean, retry_after long", step)


def reduced_incidents(events: DataFrame, parts: int | None = None) -> DataFrame:
    """``events``: id, incident, usage, event_type, created_at.  (id, incident, active, resolved): running counts after each event.

    The counts are sums over usages.  A usage is in sight from its first
    ``usage_found`` on; a pull request resolves it where it is verified and nothing
    happens to it in between.  Both are found by running minima, the counts by
    running sums; that active never falls below 0 is a reflection at the running
    minimum.  No key's rows meet in one task.
    """
    order = ["created_at", "id"]
    at = F.struct(*order)
    opened = F.col("event_type") == "pr_opened"
    rows = scans.ranged(events.select("id", "incident", "usage", "event_type", "created_at"), ["incident"], order, parts)
    rows = scans.running(rows, ["incident"], order, {"next_pr": ("min", F.when(opened, at))}, following=True).drop("_range")
    own = rows.where(F.col("event_type").isin(*Incident.AFTER) & F.col("usage").isNotNull())
    own = scans.ranged(own, ["incident", "usage"], order, parts)
    own = scans.running(own, ["incident", "usage"], order, {"found_at": ("min", F.when(F.col("event_type") == "usage_found", at))})
    seen = written(own.where("found_at is not null"), "sighted")
    seen = scans.running(seen, ["incident", "usage"], order, {"next_own": ("min", at)}, following=True)
    verified = [k for k, v in Incident.AFTER.items() if v == "verified"]
    resolved = seen.where(F.col("event_type").isin(*verified) & F.col("next_pr").isNotNull() & (F.col("next_own").isNull() | (F.col("next_pr") < F.col("next_own"))))
    steps = resolved.groupBy("incident", F.col("next_pr").alias("at")).agg(F.count("*").alias("gone")).select("incident", "at", F.lit(0).alias("come"), "gone")
    steps = steps.union(seen.where(F.col("found_at") == at).select("incident", F.col("found_at"), F.lit(1), F.lit(0).cast("long")))
    every = rows.select("id", F.col("incident"), at.alias("at"), "created_at").join(steps.select(F.col("incident").alias("_i"), F.col("at").alias("_at"), "come", "gone"), F.col("incident").eqNullSafe(F.col("_i")) & (F.col("at") == F.col("_at")), "left")
    every = scans.ranged(every.select("id", "incident", "created_at", F.coalesce("come", F.lit(0)).cast("long").alias("come"), F.coalesce("gone", F.lit(0)).alias("gone")), ["incident"], order, parts)
    sums = scans.running(every, ["incident"], order, {"sum": ("sum", F.col("come") - F.col("gone")), "resolved": ("sum", F.col("gone"))})
    low = scans.running(written(sums, "sums"), ["incident"], order, {"low": ("min", F.col("sum"))})
    return low.select("id", "incident", (F.col("sum") - F.least(F.col("low"), F.lit(0))).alias("active"), "resolved")


def fanned_out(events: DataFrame, key: str = "repo_id", n: int = FANOUT) -> DataFrame:
    """What a subscriber's bounded queue holds: each key's newest ``n`` events."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id")))
    return events.withColumn("place", place).where(F.col("place") <= n).drop("place")


def queues(events: DataFrame, subscribers: DataFrame, n: int = FANOUT) -> DataFrame:
    """What waits for each subscriber that has taken nothing yet: (subscriber, id), the newest ``n`` events of its repository, or of all.

    ``events``: id, repo_id, created_at.  ``subscribers``: subscriber, repo_id
    (null for all).  Subscribers of one scope share one computation.
    """
    scopes = subscribers.select("repo_id").where("repo_id is not null").distinct()
    own = fanned_out(events.select("id", "repo_id", "created_at").join(scopes, "repo_id", "left_semi"), n=n)
    every = events.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id")
    scoped = subscribers.where("repo_id is not null").join(own, "repo_id").select("subscriber", "id")
    # At most n events meet the subscribers without a scope.
    unscoped = subscribers.where("repo_id is null").select("subscriber").join(every.agg(F.collect_list("id").alias("ids"))).select("subscriber", F.explode("ids").alias("id"))
    return scoped.union(unscoped)


def exempt(method: str, path: str) -> Column:
    """Requests that the limiter does not see: pre-flight ones, health checks and webhooks."""
    return F.coalesce((F.col(method) == "OPTIONS") | F.col(path).isin("/health", "/health/", "/api/health", "/api/health/") | F.col(path).startswith("/webhooks"), F.lit(False))


def client_of(forwarded: str, address: str, trust_proxy: bool) -> Column:
    """Whom a request counts for: the first hop behind a trusted proxy, else the peer, else ``unknown``."""
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda h: F.trim(h)), lambda h: h != "")
    peer = F.coalesce(F.nullif(F.col(address), F.lit("")), F.lit("unknown"))
    return F.coalesce(F.get(hops, F.lit(0)), peer) if trust_proxy else peer


# Streams


def queue_stream(stream: DataFrame, n: int = FANOUT, parts: int = PARTS) -> DataFrame:
    """Bounded queues over a stream of (id, repo_id): (scope, part, ids, dropped) after each batch, for the update mode.

    A scope is a repository, or null for all of them; an event goes into both.
    The queue of all is kept in ``parts`` parts, so that no task sees every event;
    ``whole_queues`` puts them together.  When a queue is full its oldest event
    goes.  Subscribers read the queue of their scope.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        waiting = deque(ids, maxlen=n)
        for f in frames:
            fresh = f.id.tolist()
            dropped += max(0, len(waiting) + len(fresh) - n)
            waiting.extend(fresh)
        state.update((list(waiting), dropped))
        scope = None if pd.isna(key[0]) else key[0]
        yield pd.DataFrame({"scope": pd.Series([scope], dtype="object"), "part": [key[1]], "ids": [list(waiting)], "dropped": [dropped]})

    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    own, every = F.struct(F.col("repo_id").cast("string").alias("scope"), F.lit(0).alias("part")), F.struct(F.lit(None).cast("string").alias("scope"), part.alias("part"))
    rows = stream.select("id", F.explode(F.array(own, every)).alias("s")).select("id", "s.*")
    return rows.groupBy("scope", "part").applyInPandasWithState(step, "scope string, part int, ids array<long>, dropped long", "ids array<long>, dropped long", "update", GroupStateTimeout.NoTimeout)


def whole_queues(states: DataFrame, n: int = FANOUT) -> DataFrame:
    """(scope, ids, dropped) from the last states of all parts: the newest ``n`` ids, at most ``n`` of each part."""
    rows = states.groupBy("scope").agg(F.sort_array(F.flatten(F.collect_list("ids")), asc=False).alias("all"), F.sum("dropped").alias("dropped"))
    return rows.select("scope", F.array_sort(F.slice("all", 1, n)).alias("ids"), (F.col("dropped") + F.greatest(F.size("all") - n, F.lit(0))).alias("dropped"))


class Reader(StatefulProcessor):
    """What waits for one subscriber and how much it has asked for; a timer while it waits in vain."""

    def __init__(self, n: int, silence: float):
        self.n, self.silence = n, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", "ids array<long>, asked long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids, asked, dropped = self.queue.get() if self.queue.exists() else ([], 0, 0)
        waiting, out = deque(ids), []
        for row in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples(index=False):
            if row.kind == "read":
                asked += int(row.id)
            else:
                waiting.append(int(row.id))
            while asked and waiting:
                out.append((key[0], "event", waiting.popleft(), dropped))
                asked -= 1
            if len(waiting) > self.n:
                waiting.popleft()
                dropped += 1
        self.queue.update((list(waiting), asked, dropped))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if asked:  # it has taken all there was and waits
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.silence))
        yield pd.DataFrame(out, columns=["subscriber", "kind", "id", "dropped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.silence))
        yield pd.DataFrame([(key[0], "heartbeat", None, self.queue.get()[2])], columns=["subscriber", "kind", "id", "dropped"]).astype({"id": "object"})


def live_events(stream: DataFrame, subscribers: DataFrame, n: int = FANOUT, silence: float = HEARTBEAT_SECONDS) -> DataFrame:
    """What each subscriber is sent: (subscriber, kind, id, dropped), in append mode; kind is event or heartbeat.

    ``stream``: kind (``event`` or ``read``), id, repo_id, subscriber, at.  An event
    goes to the subscribers (subscriber, repo_id; null for all) of its scope; a
    read asks for ``id`` more events for its subscriber.  What is not asked for
    waits, the newest ``n`` at most.  A subscriber that waits in vain for
    ``silence`` seconds gets a heartbeat.  Needs the RocksDB state store provider.
    """
    events = stream.where("kind = 'event'").select("kind", "id", "repo_id", "at")
    scoped = events.join(subscribers.where("repo_id is not null").select("subscriber", "repo_id"), "repo_id").select("subscriber", "kind", "id", "at")
    # Each of the few subscribers of all gets every event, as it must.
    every = events.join(subscribers.where("repo_id is null").agg(F.collect_list("subscriber").alias("all"))).select(F.explode("all").alias("subscriber"), "kind", "id", "at")
    rows = scoped.union(every).union(stream.where("kind = 'read'").select("subscriber", "kind", "id", "at"))
    kind = subscribers.schema["subscriber"].dataType.simpleString()
    return rows.groupBy("subscriber").transformWithStateInPandas(Reader(n, silence), f"subscriber {kind}, kind string, id long, dropped long", "Append", "ProcessingTime")


def event_time(df: DataFrame, column: str, delay: str = "10 minutes") -> DataFrame:
    """Casts to a zoned timestamp (which watermarks need) and sets the watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def pushes(stream: DataFrame) -> DataFrame:
    """Pushes to the default branch that name a commit, each (repo_id, after) once within the watermark (column ``at``)."""
    kept = stream.where((F.col("ref") == F.concat(F.lit("refs/heads/"), "default_branch")) & (F.regexp_replace("after", "0", "") != ""))
    return kept.dropDuplicatesWithinWatermark(["repo_id", "after"])


def push_jobs(stream: DataFrame, state: DataFrame, in_flight: DataFrame, now: Column) -> DataFrame:
    """Jobs that a stream of pushes asks for, with their mode; none for a commit that is queued or running already (in_flight: repo_id, after, status)."""
    plan = scheduling.push_plan(pushes(stream), state, now).where(F.col("mode").isin("full", "incremental"))
    return scheduling.debounced(plan, in_flight, ["repo_id", "after"])


def current_states(stream: DataFrame) -> DataFrame:
    """Last event of each repository; for the update or complete mode."""
    return stream.groupBy("repo_id").agg(F.max_by("event_type", F.struct("created_at", "id")).alias("event_type"), F.max("created_at").alias("at"))


def activity_windows(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and event-time window."""
    return stream.groupBy(F.window("created_at", width, slide) if slide else F.window("created_at", width), "event_type").agg(F.count("*").alias("events"))


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return stream.groupBy(F.session_window("created_at", gap), "repo_id").agg(F.count("*").alias("events"))


def limited_stream(stream: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """The limiter over a stream of (id, client, ts); a client's state goes after two idle windows."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(limit, window, list(state.get[0]) if state.exists else [])
        for f in frames:
            f = f.sort_values(["ts", "id"])
            out = [(i, key[0], *limiter.hit(float(t))) for i, t in zip(f.id, f.ts, strict=True)]
            yield pd.DataFrame(out, columns=["id", "client", "accepted", "retry_after"])
        state.update((list(limiter.hits),))
        state.setTimeoutDuration(int(2000 * window))

    return stream.groupBy("client").applyInPandasWithState(step, "id long, client string, accepted boolean, retry_after long", "hits array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
