"""Working copies, archives, providers, guards and queues on small inputs."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from orrery.functions import callsites, diffs
from orrery.functions.text import SENTINEL
from orrery.operators import graph, local, repairs
from orrery.sources import readers, sinks
from orrery.streaming import stateful


def packed(*files: tuple[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, data in files:
            member = tarfile.TarInfo(name)
            member.size = len(data)
            archive.addfile(member, io.BytesIO(data))
        link = tarfile.TarInfo("top/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        archive.addfile(link)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(packed(("top/x.py", b"1"), ("top/d/y.py", b"2"), ("../evil", b"3"), ("/abs", b"4")))
    (tmp_path / "b.tar.gz").write_bytes(packed(("one/x.py", b"1"), ("two/y.py", b"")))
    (tmp_path / "c.tar.gz").write_bytes(b"no archive")
    got = {(r.archive, r.path): r for r in readers.archives(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", "x.py"), ("a", "d/y.py"), ("b", "one/x.py"), ("b", "two/y.py"), ("c", None)}
    assert bytes(got["a", "d/y.py"].content) == b"2" and got["c", None]._error and got["a", "x.py"]._error is None


def test_scope(spark):
    paths = ["a.TS", "a/b.cs", "a/b.md", ".git/a.py", "a/.x/b.py", "out/a.py", "a/build/b.js", ".a.py", "venv.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = lambda *rule: {r.path for r in df.where(local.in_scope("path", *rule)).collect()}
    assert kept(local.SCAN_SUFFIXES, local.SCAN_LEFT_OUT) == {"a.TS", "a/b.cs", ".a.py", "venv.py"}
    assert kept(local.VERIFY_SUFFIXES, local.VERIFY_LEFT_OUT) == {"a.TS", "out/a.py", "a/build/b.js", ".a.py", "venv.py"}


def test_receipts(spark):
    files = spark.createDataFrame([(1, "a.py", "x = 1"), (1, "b.ts", "f("), (2, "a.py", "x = 1"), (3, "a.md", "(")], "k long, path string, source string")
    outcomes = spark.createDataFrame([(1, None, True), (2, None, False), (3, None, None), (2 + 2, True, None)], "k long, types boolean, tests boolean")
    got = {r.k: (r.files_checked, r.parse_errors, r.first_error, r.all_passed, r.exit_code) for r in local.receipts(files, outcomes, "k").collect()}
    assert got == {1: (2, 1, "b.ts", False, 1), 2: (1, 0, None, False, 1), 3: (0, 0, None, True, 0), 4: (0, 0, None, True, 0)}


def test_renamed_diff_applies(spark):
    rows = [("a.ts", 2, "x = f.g(f.gh)\nf.g()", "f.g", "$h"), ("a.ts", 2, "x = 1", "f", "g"), ("a.ts", 2, "f()", "f(", "g"), ("a.ts", 2, "f()", "f", None), ("a.ts", 2, None, "f", "g")]
    df = spark.createDataFrame(rows, "path string, line_start int, snippet string, symbol string, symbol_new string")
    found = [r.diff for r in repairs.patched(df).collect()]
    assert diffs.applied("top\nx = f.g(f.gh)\nf.g()\nend\n", found[0])[:2] == (True, "top\nx = $h(f.gh)\n$h()\nend\n")
    assert found[1:] == [SENTINEL] * 4
    repairs.PROVIDERS["fixed"] = lambda rows: rows.withColumn("diff", F.lit("@@ -1 +1 @@"))
    try:
        assert [r.diff for r in repairs.patched(df, ("rename", "fixed")).collect()][1:] == ["@@ -1 +1 @@"] * 4
    finally:
        del repairs.PROVIDERS["fixed"]
    with pytest.raises(ValueError, match="unknown provider"):
        repairs.provider("none")


def test_capital_receivers():
    source = "using Acme.P;\nclass A { void B() { Other.F(1); low.F(2); } }"
    lines = lambda **k: [c["snippet"] for c in callsites.find_calls("a.cs", source, "F", "Acme.P", **k)]
    assert lines() == [] and lines(capitals=True) == ["Other.F(1)"]


def test_neighbours_fall_back_on_documents(spark):
    edge = "repo_id long, source_path string, target_path string"
    edges = spark.createDataFrame([(1, "a", "b")], edge)
    states = spark.createDataFrame([(2,)], "repo_id long")
    pairs = "array<struct<source:string,target:string>>"
    documents = spark.createDataFrame([(r, 1, s, t, [(x, "c"), ("", "c")]) for r, s, t, x in ((1, "ready", 1, "a"), (2, "ready", 1, "a"), (3, "ready", 1, "old"), (3, "ready", 2, "a"), (3, "failed", 3, "b"))] + [(4, 1, "ready", 1, None)], f"repo_id long, id long, status string, created_at long, edges {pairs}")
    asked = spark.createDataFrame([(r, "\\a") for r in (1, 2, 3, 4)] + [(1, "c")], "repo_id long, path string")
    got = {(r.repo_id, r.path): (r.imports, r.imported_by) for r in graph.neighbors_of(asked, edges, states, documents).collect()}
    assert got == {(1, "a"): ("b", ""), (1, "c"): ("", "a"), (2, "a"): ("", ""), (3, "a"): ("c", ""), (4, "a"): ("", "")}


def test_cascade(spark):
    tables = {"p": spark.createDataFrame([(1,)], "id long"), "c": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id long, p long"), "g": spark.createDataFrame([(100, 10), (200, 20)], "id long, c long")}
    left = sinks.cascaded(tables, [("c", "p", "p"), ("g", "c", "c")])
    assert {r.id for r in left["c"].collect()} == {10, 30} and {r.id for r in left["g"].collect()} == {100}


def test_limiter_scope(spark):
    rows = [("GET", "/x", "1.1.1.1, 2.2.2.2", "3.3.3.3"), ("GET", "/webhooks", " , ", "3.3.3.3"), ("OPTIONS", "/x", None, ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "m string, p string, f string, a string")
    got = df.select(stateful.exempt("m", "p"), stateful.client_of("f", "a", True), stateful.client_of("f", "a", False)).collect()
    assert [tuple(r) for r in got] == [(False, "1.1.1.1", "3.3.3.3"), (True, "3.3.3.3", "3.3.3.3"), (True, "unknown", "unknown"), (False, "unknown", "unknown")]


def test_queue_stream(spark, tmp_path):
    rows = spark.range(12).selectExpr("id", "id % 2 as repo_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stateful.queue_stream(stream, 4).writeStream.format("memory").queryName("queues").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("queues").where("scope is null").count() > 1  # no task has seen them all
    got = {r.scope: (sorted(r.ids), r.dropped) for r in stateful.whole_queues(spark.table("queues"), 4).collect()}
    assert got == {None: ([8, 9, 10, 11], 8), "0": ([4, 6, 8, 10], 2), "1": ([5, 7, 9, 11], 2)}


def test_push_jobs(spark, tmp_path):
    pushed = "repo_id long, ref string, default_branch string, before string, after string, truncated boolean, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>, at timestamp"
    one = [(["a"], [], [])]
    rows = [(1, "refs/heads/main", "c1", False), (1, "refs/heads/main", "c1", False), (1, "refs/heads/dev", "c2", False), (2, "refs/heads/main", "c3", True), (3, "refs/heads/main", "c4", False), (4, "refs/heads/main", "000", False)]
    df = spark.createDataFrame([(r, ref, "main", "b", after, cut, one, None) for r, ref, after, cut in rows], pushed).withColumn("at", F.lit("2024-01-15").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    state = spark.createDataFrame([(r, "c0", 10) for r in (1, 2, 3)], "repo_id long, head_sha string, node_count int").withColumn("last_full_scan_at", F.lit("2024-01-14").cast("timestamp"))
    jobs = spark.createDataFrame([(3, "c4", "running"), (1, "c1", "done")], "repo_id long, after string, status string")
    stream = stateful.event_time(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "at")
    query = stateful.push_jobs(stream, state, jobs, F.lit("2024-01-15").cast("timestamp")).select("repo_id", "after", "mode").writeStream.format("memory").queryName("push_jobs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("push_jobs").collect())) == [(1, "c1", "incremental"), (2, "c3", "full")]
