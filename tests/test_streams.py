"""Streams of live events, payloads and appends."""

import json
import time

import pytest
from pyspark.sql import functions as F

from orrery.sources import payloads, sinks
from orrery.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "kind string, id long, repo_id long, subscriber string, at long"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_live_events(rocks, tmp_path):
    """One subscriber keeps up and waits in vain, one is behind and loses the oldest, one sees all repositories."""
    spark = rocks
    subscribers = spark.createDataFrame([("quick", 1), ("slow", 1), ("all", None)], "subscriber string, repo_id long")
    first = [("read", 100, None, "quick", 0), ("read", 2, None, "all", 0)] + [("event", 10 + i, 1 + i % 2, None, 1 + i) for i in range(8)]
    spark.createDataFrame(first, ROW).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
    query = stateful.live_events(stream, subscribers, n=3, silence=0.5).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    got = lambda name, kind="event": [r.id for r in spark.table("live").where((F.col("subscriber") == name) & (F.col("kind") == kind)).collect()]
    try:
        end = time.time() + 120
        while time.time() < end and not got("quick", "heartbeat"):
            assert query.exception() is None
            time.sleep(0.5)
        assert got("quick") == [10, 12, 14, 16] and got("all") == [10, 11] and got("slow") == []
        assert len(got("quick", "heartbeat")) > 0 and got("slow", "heartbeat") == []
        spark.createDataFrame([("read", 10, None, "slow", 50), ("event", 30, 2, None, 51), ("event", 31, 1, None, 52)], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        end = time.time() + 120
        while time.time() < end and 31 not in got("slow"):
            time.sleep(0.5)
        assert got("slow") == [12, 14, 16, 31] and got("quick")[-1] == 31
        assert {r.dropped for r in spark.table("live").where("subscriber = 'slow' and kind = 'event'").collect()} == {1}
    finally:
        query.stop()


def test_push_payload_stream_is_appended_once(spark, tmp_path):
    push = {"ref": "refs/heads/main", "after": "", "head_commit": {"id": "h1", "timestamp": "2024-01-15T00:00:00Z"}, "repository": {"id": 7}, "before": "0" * 40, "commits": [{"added": ["a"]}] * 20}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(x) for x in (push, {"ref": "x"}, [], push | {"after": "c2", "commits": None})) + "\n{broken\n")
    rows = payloads.pushes(payloads.line_stream(spark, str(tmp_path / "in")))
    add = sinks.appending(str(tmp_path / "table"))
    twice = lambda df, batch: (add(df, batch), add(df, batch))  # noqa: E731  (as after a failure)
    query = rows.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    got = spark.read.parquet(str(tmp_path / "table")).orderBy("after").collect()
    assert [(r.repo_id, r.default_branch, r.before, r.after, r.truncated, len(r.commits), r.batch) for r in got] == [(7, "main", None, "c2", False, 0, 0), (7, "main", None, "h1", True, 20, 0)]
    assert str(got[1].at) == "2024-01-15 00:00:00" and got[1].commits[0].added == ["a"]
