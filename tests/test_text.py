"""Text functions, changelogs, call sites, imports, diffs and folds."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import callsites, changelog, diffs, imports, text
from orrery.plans import fixtures
from orrery.sources import readers
from orrery.streaming import graph_updates, stateful


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(column).first()[0]


@pytest.mark.parametrize(("path", "flag"), [("a/tests/x.py", True), ("latest.ts", False), ("src/x.test.tsx", True), ("test_a.py", True), ("Latest.java", False), ("FooTest.java", True), ("FooTests.cs", True), ("Contest.cs", False), ("a/spec/b.rb", True), ("testing/x.py", False)])
def test_test_files(spark, path, flag):
    assert value(spark, text.is_test_file("p"), p=path) is flag


def test_small_functions(spark):
    assert value(spark, text.redacted("t"), t="key sk-" + "a" * 20 + " end " + "Z9" * 20) == "key [REDACTED] end [REDACTED]"
    assert value(spark, text.normalized("p"), p="/a/./b/../c\\d") == "a/c/d"
    assert value(spark, text.normalized("p"), p="../x") == "../x"
    assert value(spark, text.extension("p"), p="a/B.TS") == ".ts" and value(spark, text.extension("p"), p=".env") == ""
    assert value(spark, text.import_names("n"), n="Scikit_Learn") == ["scikit_learn", "sklearn"]
    assert value(spark, text.registry_name("n"), n="@scope/pkg name") == "@scope/pkg%20name"
    assert value(spark, text.extracted_diff("t"), t="ok\n```diff\n--- a\n+++ b\n```\n") == "--- a\n+++ b"
    assert value(spark, text.extracted_diff("t"), t="nothing") == value(spark, text.extracted_diff("t"), t="x UNABLE_TO_PATCH") == text.SENTINEL
    assert value(spark, text.failure_class("t"), t='```json\n{"classification": "transient"}\n```') == "transient"
    assert value(spark, text.failure_class("t"), t="{broken") == "unknown"
    assert value(spark, text.extracted_changes("t"), t='[{"symbol_old": "a"}]')[0] == ("a", None, "signature_change", "", 0.8)
    assert value(spark, text.extracted_changes("t"), t='[{"symbol": "a", "symbol_new": "b", "confidence": "0.25"}]')[0] == ("", "b", "signature_change", "", 0.25)
    assert value(spark, text.extracted_changes("t"), t='{"symbol": "a"}') is None
    assert value(spark, text.log_sha(F.col("t"), "base"), t="x [base_sha:abc1] y") == "abc1" and value(spark, text.log_sha(F.col("t"), "commit"), t="x") is None
    assert value(spark, text.redirect_allowed(F.col("u"), ("ok.org",)), u="https://ok.org/x") and not value(spark, text.redirect_allowed(F.col("u"), ("ok.org",)), u="//evil.org")
    assert value(spark, text.round3(F.col("x").cast("double")), x="0.0005") == round(0.0005, 3)


def test_signature(spark):
    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    for header, secret, ok in ((good, "k", True), (good, "other", False), (good, None, False), (good[7:], "k", False), (None, "k", False)):
        df = spark.createDataFrame([("body", header, secret)], "b string, h string, s string")
        assert df.select(text.signature_valid(F.encode("b", "UTF-8"), "h", "s")).first()[0] is ok


def test_changelog(spark):
    df = spark.createDataFrame(fixtures.CHANGELOGS, "id string, changelog string")
    got = {}
    for row in changelog.changelog_changes(df).orderBy("id", "position").collect():
        got.setdefault(row.id, []).append((row.symbol, row.symbol_new, row.change_type))
    assert got["a"] == [("openFile", "open_file", "renamed"), ("getAll", "list_all", "renamed"), ("retry", "retry", "signature_change")]
    assert got["b"] == [("legacy", None, "removed"), ("oldCall", None, "removed"), ("py36", None, "removed"), ("slow_path", None, "deprecated")]


CALLS = [
    ("a.ts", "import { f } from 'p';\nf(1);\n", "f", "p", [2]), ("a.ts", "function f() {}\nf(1);\n", "f", "p", []), ("a.ts", "import { f } from 'q';\nf(1);\n", "f", "p", []),
    ("a.ts", "import { f as g } from 'p';\ng(1);\n", "f", "p", [2]), ("a.ts", "import p from 'p';\nconst c = new p.C();\nc.f();\n// f()\n", "f", "p", [3]),
    ("a.js", "const { f: h } = require('p');\nh('f()');\n", "f", "p", [2]), ("a.tsx", "import * as p from 'p';\np.f(<b/>);\n", "p.f(x)", "p", [2]),
    ("a.py", "import p\nfrom p import f as g\n\np.f()\ng()\ndef f():\n    return f()\n", "f", "p", [4, 5]), ("a.py", "def broken(:\n", "f", "p", []),
    ("a.cs", "class A { void B() { Other.F(1); } }", "F", "Acme.P", []), ("a.unknown", "f()", "f", "p", []),
]


@pytest.mark.parametrize(("path", "source", "symbol", "package", "lines"), CALLS)
def test_calls(path, source, symbol, package, lines):
    assert [c["line_start"] for c in callsites.find_calls(path, source, symbol, package)] == lines


def test_parses():
    assert callsites.parses("a.py", "x = 1") and not callsites.parses("a.py", "x = (") and callsites.parses("a.ts", "f('(')") and not callsites.parses("a.ts", "f(") and callsites.parses("a.md", "(") is None


def test_import_graph_and_increment(spark):
    tree = spark.createDataFrame(fixtures.TREE, "repo_id string, path string, content string").withColumn("content", F.encode("content", "UTF-8"))
    graph = graph_updates.full_build(tree)
    nodes, specs, edges = imports.files(tree), graph.specs, graph.edges
    want = {("src/app.ts", "src/b.tsx"), ("src/app.ts", "src/lib/a.ts"), ("src/b.tsx", "src/lib/a.ts"), ("pkg/core.py", "pkg/__init__.py"), ("pkg/__init__.py", "pkg/core.py"), ("native/main.c", "native/util.h"), ("src/main.rs", "src/store/disk.rs")}
    pairs = lambda e: {(x.source_path, x.target_path) for x in e.collect()}
    assert pairs(edges) == want
    _, missing = imports.resolved(nodes, specs, imports.aliases(nodes))
    assert {(x.path, x.spec) for x in missing.collect()} == {("src/app.ts", "./missing"), ("src/app.ts", "name")}
    change = spark.createDataFrame([("r", "src/missing.ts", "import './b';\n"), ("r", "src/b.tsx", "export {};\n")], "repo_id string, path string, content string").withColumn("content", F.encode("content", "UTF-8"))
    removed = spark.createDataFrame([("r", "native/util.h")], "repo_id string, path string")
    after = tree.join(change.select("path"), "path", "left_anti").where("path <> 'native/util.h'").select("repo_id", "path", "content").union(change)
    assert pairs(graph_updates.incremental(graph, change, removed).graph.edges) == pairs(graph_updates.full_build(after).edges)


@pytest.mark.parametrize("out", [[0, 1], [2, 3, 4], [1, 6, 8, 10]])
def test_increments_are_full_builds(spark, out):
    """Files that come, and then go again, leave the graph of a full build behind."""
    rows = fixtures.TREE
    frame = lambda rs: spark.createDataFrame(rs, "repo_id string, path string, content string").withColumn("content", F.encode("content", "UTF-8"))
    pairs = lambda e: sorted((x.source_path, x.target_path) for x in e.collect())
    some = [rows[i] for i in out]
    rest = [x for x in rows if x not in some]
    before, whole = graph_updates.full_build(frame(rest)), graph_updates.full_build(frame(rows))
    none, gone = frame(some).limit(0), frame(some).select("repo_id", "path")
    rows = lambda frames: [sorted(map(str, f.collect())) for f in frames]
    assert rows(graph_updates.incremental(before, frame(some), gone.limit(0)).graph) == rows(whole)
    assert rows(graph_updates.incremental(whole, none, gone).graph) == rows(before)


@pytest.mark.parametrize(
    ("original", "diff", "ok", "content"),
    [
        ("a\nb\n", "@@ -1,2 +1,2 @@\n a\n-b\n+c\n", True, "a\nc\n"), ("a\nb\n", "@@ -1,2 +1,3 @@\n a\n-b\n+c\n", False, "a\nb\n"), ("a\nb\n", "", False, "a\nb\n"), ("a\nb\n", "no hunks", False, "a\nb\n"),
        ("x\n" * 20 + "a\nb\n", "@@ -1,2 +1,2 @@\n a\n-b\n+c\n", True, "x\n" * 20 + "a\nc\n"), ("x\n" * 40 + "a\n", "@@ -1 +1 @@\n-a\n+b\n", False, "x\n" * 40 + "a\n"),
        ("a\r\nb\r\n", "@@ -2,1 +2,1 @@\n-b\n+c\n", True, "a\r\nc\r\n"), ("a\n", "@@ -0,0 +1,1 @@\n+z\n", True, "z\na\n"), ("a\nb\nc\n", "@@ -1,1 +1,0 @@\n-a\n@@ -3,0 +3,1 @@\n+d\n", True, "b\nc\nd\n"),
    ],
)
def test_diffs(original, diff, ok, content):
    assert diffs.applied(original, diff)[:2] == (ok, content)


def test_limiter_and_fold(spark):
    limiter = stateful.Limiter(2, 10.0)
    assert [limiter.hit(t) for t in (1000, 1004, 1004, 1010.1, 1014.1)] == [(True, 0), (True, 0), (False, 6), (True, 0), (True, 0)]
    rnd = random.Random(0)
    rows = [(i, rnd.choice("abc"), round(rnd.random() * 200, 2)) for i in range(400)]
    got = {r.id: r.accepted for r in stateful.rate_limited(spark.createDataFrame(rows, "id long, client string, ts double"), 5, 20.0).collect()}
    machines = {}
    want = {i: machines.setdefault(c, stateful.Limiter(5, 20.0)).hit(t)[0] for i, c, t in sorted(rows, key=lambda r: (r[2], r[0]))}
    assert got == want


def test_incident_reducer():
    machine = stateful.Incident()
    assert [machine.event(*e) for e in (("usage_found", 1), ("usage_found", 1), ("validation_passed", 1), ("usage_found", 2), ("pr_opened", None), ("pr_opened", None))] == [(1, 0), (1, 0), (1, 0), (2, 0), (1, 1), (1, 1)]


def test_streams_match_batch(spark, tmp_path):
    rows = [(i, "abc"[i % 3], float(i // 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, client string, ts double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stateful.limited_stream(stream, 5, 10.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("limited").collect()} == {tuple(r) for r in stateful.rate_limited(df, 5, 10.0).collect()}
    pushes = spark.createDataFrame([(1, "refs/heads/main", "main", "a"), (1, "refs/heads/main", "main", "a"), (1, "refs/heads/x", "main", "b"), (2, "refs/heads/main", "main", "000")], "repo_id int, ref string, default_branch string, after string")
    pushes.withColumn("at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = stateful.event_time(spark.readStream.schema(spark.read.parquet(str(tmp_path / "p")).schema).parquet(str(tmp_path / "p")), "at")
    query = stateful.pushes(stream).writeStream.format("memory").queryName("pushes").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.repo_id, r.after) for r in spark.table("pushes").collect()] == [(1, "a")]


def test_registry_answers(spark):
    npm = '{"dist-tags": {"latest": "2.0.0"}, "homepage": "http://top", "time": {"2.0.0": "2024-01-02T03:04:05Z"}, "versions": {"1.0.0": {}, "2.0.0": {"repository": {"url": "http://r"}, "changelog": "c"}}}'
    pypi = '{"info": {"version": "1.1", "home_page": "http://h", "project_urls": {"Change Log": "http://c", "History": "http://d"}}, "releases": {"1.0": [], "1.1": []}, "urls": [{"upload_time_iso_8601": "2024-01-02T03:04:05Z"}]}'
    empty = '{"dist-tags": {"latest": ""}, "versions": {}}'
    df = spark.createDataFrame([("a", "npm", npm), ("b", " PyPI", pypi), ("c", "cargo", npm), ("d", "npm", empty)], "name string, ecosystem string, json string")
    got = {r.name: (r.version, str(r.published_at), r.url, r.notes) for r in readers.latest_versions(df).collect()}
    assert got == {"a": ("2.0.0", "2024-01-02 03:04:05", "http://r", "c"), "b": ("1.1", "2024-01-02 03:04:05", "http://c", None), "c": (None, "None", None, None), "d": (None, "None", None, None)}
    assert {r.name: r.versions for r in readers.all_versions(df).collect()} == {"a": ["2.0.0", "1.0.0"], "b": ["1.1", "1.0"], "c": None, "d": []}


@pytest.mark.parametrize(
    ("url", "allowed"),
    [("/next", True), ("//evil.org", False), ("https://OK.org/x", True), ("https://ok.org:8443/", False), ("http://localhost:3000/", True), ("http://localhost.evil.org/", False), ("ftp://ok.org/", False), ("http://u@ok.org/", False), ("", False), (None, False)],
)
def test_redirects(spark, url, allowed):
    assert bool(value(spark, text.redirect_allowed(F.col("u"), ("ok.org",)), u=url)) is allowed


def test_relative_times(spark):
    now = F.expr("timestamp '2024-01-15 00:00:00'")
    said = {"2024-01-14T23:59:30Z": "30s ago", "2024-01-14T23:00:01Z": "59m ago", "2024-01-01T00:00:00Z": "14d ago", "2023-12-05T00:00:00Z": "Dec 05, 2023", "not a time at all": "not a time", "2024-01-14T23:59:30": "2024-01-14", "2024-01-14": "2024-01-14", "2024-01-15T01:59:30+02:00": "30s ago", None: "recently", "": "recently"}
    for at, words in said.items():
        assert value(spark, text.relative_time("t", now), t=at) == words


def test_gates(spark):
    from itertools import product

    rows = list(product((True, False, None), (True, False, None), (True, False), (True, False), (True, False, None), (True, False), (True, None), (True, False)))
    df = spark.createDataFrame(rows, "tests boolean, types boolean, need_tests boolean, need_types boolean, ok boolean, has_tests boolean, has_types boolean, done boolean").selectExpr("*", "true as applies", "true as parses", "true as scope")
    lenient = diffs.gate("tests", "types", "need_tests", "need_types", "ok")
    strict = diffs.strict_gate("applies", "parses", "scope", "tests", "types", "need_tests", "need_types", "has_tests", "has_types", "done", "ok")
    for r in df.select("*", lenient.alias("gate"), strict.alias("strict")).collect():
        required = (r.tests is True or not r.need_tests) and (r.types is True or not r.need_types)
        assert r.gate == ("verified" if required and r.ok else "failed")
        found = (r.tests is True or not r.has_tests) and (r.types is True or not r.has_types)
        assert r.strict is bool(required and found and r.done and r.ok and r.tests is not False and r.types is not False)


def test_grounding(spark):
    found = [("Circular dependency cycle detected (1 total)", "Cycle in module graph (a.ts)", "break the cycle at src/a.ts", "?focus=src/a.ts&x=1"), ("3 upstream breaking changes pending", "", "", "")]
    cases = [
        ([], found, False), (["Break the import cycle in src/a.ts first"], found, True), (["Break the import cycle in src/b.ts"], found, False), (["Review the breaking changes of @acme/kit"], found, False),
        (["Plant more trees"], found, False), (["Upgrade pending dependency changes of @known/pkg"], found, False), (["Look at http://x/y about the cycle detected"], found, True), (["anything at all"], [], True), (["see lib/x.py"], [], False), (None, found, False),
    ]
    df = spark.createDataFrame([(i, a, f, ["@known/pkg"]) for i, (a, f, _) in enumerate(cases)], "id int, advice array<string>, findings array<struct<title:string,why:string,what:string,link:string>>, packages array<string>")
    from orrery.operators import lookup

    assert {r.id: r.grounded for r in lookup.grounded(df).collect()} == {i: ok for i, (_, _, ok) in enumerate(cases)}


def test_uuids(spark):
    plain = "12345678-1234-1234-1234-123456789abc"
    for spelling in (plain, plain.upper(), plain.replace("-", ""), "{" + plain + "}", "urn:uuid:" + plain):
        assert value(spark, text.uuid_or_null("u"), u=spelling) == plain
    assert value(spark, text.uuid_or_null("u"), u="nope") is None and value(spark, text.uuid_or_null("u"), u=None) is None
