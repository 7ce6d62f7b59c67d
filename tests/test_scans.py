"""Running aggregates, the limiter and the incident reducer over ranges: one key with all rows spreads over tasks."""

import random

import numpy as np
from pyspark.sql import functions as F

from orrery.streaming import scans, stateful


def test_one_client_over_many_ranges(spark):
    rnd, at, rows = random.Random(3), 0.0, []
    for i in range(1500):  # nearly always busy: few pauses of a whole window
        at += rnd.choice([0, 0.5, 1, 2, 9, 25 if i % 300 == 0 else 1])
        rows.append((i, "hot", round(at, 3)))
    rows += [(2000 + i, rnd.choice(["a", "b", "zz", None]), rnd.random() * 100) for i in range(200)]
    hits = spark.createDataFrame(rows, "id long, client string, ts double")
    ranged = scans.ranged(hits, ["client"], ["ts", "id"], 12)
    assert ranged.where("client = 'hot'").select("_range").distinct().count() > 6
    machines, want = {}, {}
    for i, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = machines.setdefault(c, stateful.Limiter(4, 20.0)).hit(t)
    got = {r.id: (r.accepted, r.retry_after) for r in stateful.rate_limited(hits, 4, 20.0, parts=12).collect()}
    assert got == want and len({a for a, _ in got.values()}) == 2


def test_limiter_over_many_hits(spark, monkeypatch):
    """Of 20,000 hits of one client few are accepted; the others are not taken one by one."""
    rnd = random.Random(6)
    times = np.sort(np.round([rnd.random() * 900 + 1.7e9 for _ in range(20_000)], 3))
    whole, single = stateful.Limiter(4, 20.1), stateful.Limiter(4, 20.1)
    want = [single.hit(t) for t in times.tolist()]
    monkeypatch.setattr(stateful.Limiter, "hit", None)
    accepted, wait = zip(*(whole.run(part) for part in np.split(times, [1, 500, 501, 7000])), strict=True)
    assert list(zip(np.concatenate(accepted).tolist(), np.concatenate(wait).tolist(), strict=True)) == want
    assert whole.hits == single.hits and all(type(h) is float for h in whole.hits)
    hits = spark.createDataFrame([(i, "c", t) for i, t in enumerate(times.tolist())], "id long, client string, ts double")
    assert [(r.accepted, r.retry_after) for r in stateful.rate_limited(hits, 4, 20.1, parts=3).orderBy("id").collect()] == want


def test_reducer_merges_runs(spark):
    rnd, rows = random.Random(4), []
    kinds = [*stateful.Incident.AFTER, "pr_opened", "usage_found", "validation_passed", "other"]
    for i in range(900):
        rows.append((i, rnd.choice(["one", "one", "one", "two", None]), rnd.choice([*range(5), None]), rnd.choice(kinds), rnd.randrange(400)))
    events = spark.createDataFrame(rows, "id long, incident string, usage long, event_type string, created_at long")
    machines, want = {}, {}
    for i, incident, usage, kind, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        want[i] = machines.setdefault(incident, stateful.Incident()).event(kind, usage)
    got = {r.id: (r.active, r.resolved) for r in stateful.reduced_incidents(events, parts=9).collect()}
    assert got == want and max(r for _, r in got.values()) > 10 and min(a for a, _ in got.values()) == 0
    assert stateful.reduced_incidents(events.limit(0)).count() == 0


def test_running_both_ways(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, rnd.randrange(100)])) for i in range(300)]
    ranged = scans.ranged(spark.createDataFrame(rows, "id long, k long, x long"), ["k"], ["id"], 7)
    total = scans.running(ranged, ["k"], ["id"], {"total": ("sum", F.col("x")), "low": ("min", F.col("x"))})
    after = scans.running(ranged, ["k"], ["id"], {"next": ("min", F.when(F.col("x") > 50, F.col("id")))}, following=True)
    for r in total.collect():
        seen = [x for i, k, x in rows if k == r.k and i <= r.id and x is not None]
        assert (r.total, r.low) == (sum(seen), min(seen, default=None))
    for r in after.collect():
        assert r.next == min((i for i, k, x in rows if k == r.k and i > r.id and x is not None and x > 50), default=None)
