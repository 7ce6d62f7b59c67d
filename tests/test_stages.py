"""Jobs through the stages: cases, batch against plain folds, the stream with timers against the batch."""

import random

from orrery.streaming import stages

FACTS = "id long, job string, kind string, worker long, at double"


def test_one_job():
    job = stages.Job(stages.Rules(lease=10, retry=5, max_attempts=2))
    seen = [job.event(*e) for e in (("done", 1, 0), ("claimed", 1, 1), ("heartbeat", 2, 5), ("heartbeat", 1, 8), ("done", 1, 18), ("claimed", 1, 20), ("failed", 1, 21), ("claimed", 1, 25), ("claimed", 1, 26), ("other", 1, 36), ("claimed", 1, 36.5))]
    assert seen == [[], [(1, "poll_registry", "running", 1)], [], [], [(18, "extract_changes", "queued", 0)], [(20, "extract_changes", "running", 1)], [(21, "extract_changes", "queued", 1)], [], [(26, "extract_changes", "running", 2)], [], [(36, "extract_changes", "failed", 2)]]


def facts(spark, n=600):
    rnd, rows = random.Random(8), []
    for i in range(n):
        rows.append((i, rnd.choice(["a", "a", "b", "c", "d"]), rnd.choice(["claimed", "claimed", "claimed", "heartbeat", "done", "done", "failed", "odd"]), rnd.choice([1, 1, 2, None]), float(i * 7 // 2)))
    return rows


def plain(rows, rules, until):
    jobs, out = {}, []
    for _, job, kind, worker, at in sorted(rows, key=lambda r: (r[4], r[0])):
        out += [(job, *s) for s in jobs.setdefault(job, stages.Job(rules)).event(kind, worker, at)]
    return sorted(out + [(k, *s) for k, j in jobs.items() for s in j.expire(until)])


def test_batch_and_stream(spark, tmp_path):
    rules = stages.Rules(lease=20.0, retry=6.0, max_attempts=3)
    # Job "x" is claimed once and never heard of again; "z" comes last, so that the watermark passes every lease.
    rows = facts(spark)
    rows.insert(29, (9000, "x", "claimed", 1, 100.0))
    df = spark.createDataFrame(rows, FACTS)
    want = plain(rows, rules, 5000.0)
    assert {r[3] for r in want} == {"queued", "running", "failed"} | ({"done"} if any(r[3] == "done" for r in want) else set())
    assert sorted(map(tuple, stages.staged(df, 5000.0, rules, parts=5).collect())) == want
    steps = [rows[:200], rows[200:], [(9999, "z", "odd", 1, 5000.0)], [(10000, "z", "odd", 1, 5001.0)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, some in enumerate(steps):
            spark.createDataFrame(some, FACTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(FACTS).parquet(str(tmp_path / "in"))
            query = stages.stage_stream(stream, rules).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want
