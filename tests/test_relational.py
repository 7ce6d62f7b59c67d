"""Scores, gates, findings, graphs, queues and sinks on small tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, reporting as r, scheduling, scoring, tenancy
from orrery.sources import sinks

EDGE = "repo_id string, source_path string, target_path string"


def edges(spark, *pairs):
    return spark.createDataFrame([("r", a, b) for a, b in pairs], EDGE)


@pytest.mark.parametrize(
    ("pairs", "cycles", "members", "depth"),
    [
        ([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")], 1, "A,B,C", 1),
        ([("A", "B"), ("B", "C")], 0, "", 3),
        ([("A", "B"), ("B", "C"), ("C", "D"), ("A", "E")], 0, "", 4),
        ([("A", "A"), ("A", "B")], 1, "A", 1),
        ([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("A", "B")], 2, "A,B,C,D", 0),
        ([(f"n{i:05}", f"n{i + 1:05}") for i in range(5000)], 0, "", 5001),
    ],
)
def test_cycles_and_chain(spark, pairs, cycles, members, depth):
    row = graph.cycles_and_chains(edges(spark, *pairs)).first()
    assert (row.cycles_count, row.cycle_nodes, row.chain_depth) == (cycles, members, depth)


def test_cycles_against_reachability(spark):
    rnd = random.Random(1)
    for _ in range(5):
        pairs = {(str(rnd.randint(0, 12)), str(rnd.randint(0, 12))) for _ in range(16)}
        reach = set(pairs)
        for k, i, j in itertools.product(map(str, range(13)), repeat=3):
            if (i, k) in reach and (k, j) in reach:
                reach.add((i, j))
        inside = {a for a, b in reach if (b, a) in reach}
        row = graph.cycles_and_chains(edges(spark, *pairs)).first()
        assert row.cycle_nodes == ",".join(sorted(inside))
        assert row.cycles_count == len({frozenset(b for b in inside if (a, b) in reach and (b, a) in reach) for a in inside})


def test_degrees_orphans_neighbours(spark):
    nodes = spark.createDataFrame([("r", p, e) for p, e in (("a", ".ts"), ("b", ".ts"), ("c", ".md"), ("d", None))], "repo_id string, path string, ext string")
    e = edges(spark, ("a", "b"), ("a", "b"), ("a", "x"))
    kept = graph.known_edges(nodes, e)
    assert kept.count() == 2
    assert {x.path: (x.fan_in, x.fan_out) for x in graph.degrees(nodes, kept).collect()} == {"a": (0, 2), "b": (2, 0), "c": (0, 0), "d": (0, 0)}
    assert [x.path for x in graph.orphans(nodes, kept).collect()] == ["d"]
    assert {(x.path, x.imports, x.imported_by) for x in graph.neighbors(kept).collect()} == {("a", "b", ""), ("b", "", "a")}
    assert {(x.path, x.hops) for x in graph.blast_radius(edges(spark, ("a", "b"), ("b", "c"), ("c", "a")), spark.createDataFrame([("r", "c")], "repo_id string, path string")).collect()} == {("c", 0), ("b", 1), ("a", 2)}


def test_scores(spark):
    df = spark.sql("select 1 as cycles, 0 as hubs, 0.05D as orphans, true as open, 20 as nodes, 0 as none")
    assert df.select(scoring.structure_score("cycles", "hubs", "orphans", "open", "nodes")).first()[0] == 78
    assert df.select(scoring.structure_score("cycles", "hubs", "orphans", "open", "none")).first()[0] is None
    assert spark.sql("select 1 as b, 2 as o, 5 as t").select(scoring.dependency_score("b", "o", "t")).first()[0] == 70
    four = {n: n for n, _ in scoring.WEIGHTS}
    assert spark.sql("select 80 as structure, 80 as dependency, 80 as change_safety, 80 as verification").select(scoring.composite_score(**four)).first()[0] == 80
    assert spark.sql("select cast(null as int) as structure, cast(null as int) as dependency, cast(null as int) as change_safety, cast(null as int) as verification").select(scoring.composite_score(**four)).first()[0] == 75


@pytest.mark.parametrize(("kind", "sure", "risk", "plain"), [("behavior_change", 1.0, True, False), ("signature_change", 0.74, True, False), ("signature_change", 0.75, False, True), ("deprecated", 0.1, True, False), ("removed", 0.1, False, True), ("unknown", 0.1, False, False), (None, None, False, False)])
def test_risk(spark, kind, sure, risk, plain):
    df = spark.createDataFrame([(kind, sure)], "change_type string, confidence double")
    assert tuple(df.select(r.semantic_risk(), r.mechanical()).first()) == (risk, plain)


def test_three_valued_all(spark):
    values = [("T", True, 1), ("F", False, 1), ("N", None, 1), ("-", None, None)]
    rows, want = [], {}
    for n in (1, 2, 3):
        for combo in itertools.product(values, repeat=n):
            key = "".join(c[0] for c in combo)
            rows += [(key, c[1], c[2]) for c in combo]
            want[key] = None if "-" in key else False if "F" in key else None if "N" in key else True
    got = spark.createDataFrame(rows, "k string, ok boolean, run int").groupBy("k").agg(r.tri_all("ok", "run").alias("all"))
    assert {x.k: x["all"] for x in got.collect()} == want


def test_access(spark):
    repos = spark.createDataFrame([(1, 1), (2, 2)], "id int, installation_id int")
    installations = spark.createDataFrame([(1, 7, "Acme"), (2, 8, "ANN")], "id int, installed_by int, account_login string")
    users = spark.createDataFrame([(7, "bob"), (9, "ann")], "id int, login string")
    seen = tenancy.visible_repos(repos, installations, users)
    assert {tuple(x) for x in seen.collect()} == {(7, 1), (9, 2)}
    assert {tuple(x) for x in tenancy.visible_repos(repos, installations, users, operators=(7,)).collect()} == {(7, 1), (7, 2), (9, 2)}
    asked = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "user_id int, repo_id int")
    assert {tuple(x) for x in tenancy.access_outcome(asked, repos, seen).collect()} == {(7, 1, 200), (7, 2, 403), (7, 3, 404)}


def test_push_plan_limits_are_strict(spark):
    def plan(changed, nodes, scanned, **over):
        row = {"repo_id": 1, "ref": "refs/heads/main", "default_branch": "main", "after": "c2", "truncated": False, "commits": [([f"p{i}" for i in range(changed)], [], None)]} | over
        push = spark.createDataFrame([tuple(row.values())], "repo_id int, ref string, default_branch string, after string, truncated boolean, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>")
        state = spark.createDataFrame([(1, "c1", scanned, nodes)], "repo_id int, head_sha string, last_full_scan_at string, node_count int").withColumn("last_full_scan_at", F.col("last_full_scan_at").cast("timestamp"))
        return scheduling.push_plan(push, state, F.lit("2024-01-08").cast("timestamp")).first()["mode"]

    assert plan(4, 10, "2024-01-01") == "incremental"
    assert plan(5, 10, "2024-01-01") == "full"
    assert plan(1, 10, "2023-12-31 23:59:59") == "full"
    assert plan(1, 0, "2024-01-08") == "full"
    assert plan(1, 10, "2024-01-08", after="c1") == "skipped"
    assert plan(1, 10, "2024-01-08", after="0000") == "ignored"
    assert plan(1, 10, "2024-01-08", ref="refs/heads/x") == "ignored"


def test_sinks(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id int, v string")
    assert {tuple(x) for x in sinks.insert_absent(now, new, ["id"]).collect()} == {(3, "d")}
    assert {tuple(x) for x in sinks.upserted(now, new.distinct(), ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(x) for x in sinks.snapshot_diff(now, new.distinct()).collect()} == {(1, False), (2, True), (3, True)}
    patch = spark.createDataFrame([(1, None), (2, "z")], "id int, v string")
    assert {tuple(x) for x in sinks.partial_update(now, patch).collect()} == {(1, "a"), (2, "z")}
    bad = spark.createDataFrame([(1, "npm"), (1, "cargo")], "id int, ecosystem string")
    assert {tuple(x) for x in sinks.violations(bad, "packages", ["id"]).collect()} == {("enum ecosystem", "cargo", 1), ("unique id", "1", 2)}


@pytest.mark.parametrize(
    ("head", "base", "now", "job", "decision"),
    [
        ("a", "b", "a", "c", "stale"), ("c", "b", "c", "c", "skipped"), ("a", "a", "a", "c", "publish"), ("a", "a", "c", "c", "publish"), ("a", "a", "d", "c", "conflict"), (None, None, None, "c", "publish"),
        (None, None, "d", "c", "conflict"), (None, "b", "b", "c", "publish"), ("a", None, "a", "c", "publish"), ("c", None, "c", "c", "publish"), ("a", "", "d", "c", "conflict"),
    ],
)
def test_publication(spark, head, base, now, job, decision):
    df = spark.createDataFrame([(head, base, now, job)], "h string, b string, n string, t string")
    assert df.select(scheduling.publish_decision("h", "b", "n", "t")).first()[0] == decision


def test_full_builds_do_not_overtake(spark):
    cases = [(None, None, "c", False), (None, "b", "c", True), ("c", "b", "c", False), ("b", "b", "c", False), ("d", "b", "c", True), ("d", None, "c", True)]
    df = spark.createDataFrame(cases, "n string, e string, t string, stale boolean")
    assert all(r[0] == r[1] for r in df.select(scheduling.full_build_is_stale("n", "e", "t"), "stale").collect())


def test_check_conclusion(spark):
    runs = [(1, True, True, True, None, None), (2, True, True, True, True, False), (3, None, True, True, True, True), (4, True, True, True, True, True)]
    runs = spark.createDataFrame(runs, "patch_id int, applies_cleanly boolean, parses boolean, scope_ok boolean, tests_pass boolean, typechecks boolean").selectExpr("*", "1 as created_at", "0 as tie", "0 as tie2", "0 as tie3")
    pulls = spark.createDataFrame([(1, 1), (1, 4), (2, 2), (3, 3), (4, 4), (4, 9), (5, 2), (5, 9)], "pr_id int, patch_id int")
    assert {x.pr_id: x.conclusion for x in r.check_conclusion(pulls, runs).collect()} == {1: "success", 2: "failure", 3: "failure", 4: "neutral", 5: "failure"}


def test_repeated_keys_in_sinks(spark):
    now = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "x"), (2, "y"), (2, None)], "id int, v string")
    assert {tuple(x) for x in sinks.upserted(now, new, ["id"]).collect()} == {(1, "c"), (2, "y")}
    assert {tuple(x) for x in sinks.insert_absent(now, new, ["id"]).collect()} == {(2, "y")}


def test_lists_limit_before_they_sort(spark):
    usages = spark.range(30).selectExpr("id", "id as detected_change_id", "1L as repo_id")
    changes = spark.range(29).selectExpr("id", "'deprecated' as change_type", "id / 100.0D as confidence")
    patches = spark.range(30).selectExpr("id", "id as code_usage_id", "true as verified", "id as created_at")
    got = r.patch_list(patches, usages, changes, "confidence_desc", n=3).orderBy("position").collect()
    assert [x.id for x in got] == [28, 27, 29]  # the unknown confidence is picked first and listed last


def test_views_read_whole_tables(spark):
    """No view leaves rows of its table out."""
    from orrery.plans.bindings import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    orders, lines, ns, np = d.table("orders"), d.table("lineitem"), d.table("supplier").count(), d.table("part").count()
    assert d.pull_requests.count() == d.analysis_runs.count() == orders.count()
    assert {tuple(r) for r in d.pr_patches.collect()} == {(r.l_orderkey, r.l_orderkey * 10 + r.l_linenumber) for r in lines.collect()}
    assert {tuple(r) for r in d.atlas_links.collect()} == {(r.l_partkey, (r.l_partkey + ns * int(r.l_quantity)) % np) for r in lines.collect()}


def test_links_are_dealt_by_their_rows(spark, monkeypatch):
    """Shuffles get partitions by the rows of the links' table; where these are few, the settings stay."""
    from orrery.plans import bindings

    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    old = {k: spark.conf.get(k) for k in settings}
    folder = "/root/testdata/sf0.001"
    try:
        whole = bindings.Domain(spark, folder).atlas_edges.count()
        assert {k: spark.conf.get(k) for k in settings} == old
        rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
        monkeypatch.setattr(bindings, "ROWS_IN_PARTITION", rows // 7)
        edges = bindings.Domain(spark, folder).atlas_edges
        assert int(spark.conf.get(settings[0])) in (7, 8) and spark.conf.get(settings[1]) == "16m" and edges.count() == whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_compute_the_evidence_once(spark, monkeypatch, capsys):
    """Cycles are one grouped step of the evidence: of summaries one plan holds it once, of records all that is written."""
    from orrery.plans import queries, services
    from orrery.sources import scratch

    folder, append, steps = "/root/testdata/sf0.001", sinks.append_once, []

    def noted(df):
        capsys.readouterr()
        df.explain()
        steps.append(capsys.readouterr().out.count("FlatMapGroupsInPandas"))
        return df

    monkeypatch.setattr(services, "written", lambda df, name: scratch.written(noted(df), name), raising=False)
    monkeypatch.setattr(sinks, "append_once", lambda df, *to: append(noted(df), *to))
    noted(queries.QUERIES["run_summaries"](spark, folder))
    assert steps == [1]
    assert queries.QUERIES["run_records"](spark, folder).count() == spark.read.parquet(f"{folder}/supplier.parquet").count()
    assert sum(steps) == 2


def test_records_of_odd_evidence(spark):
    """A repository without findings has an empty list and one thing to do; a row of no repository has no record."""
    hub, gap = "named_struct('path', 'src/a.ts', 'fan_in', 15L, 'fan_out', 2L)", "named_struct('path', 'src/b.ts', 'unresolved', 3)"
    rows = spark.sql(f"""select *, 'c' as head, 90 as structure, cast(null as int) as dependency, 70 as change_safety, 75 as verification, array('z') as breaking_packages from values
        (1L, 'one', 61, 7L, 2L, 'x/a,x/b', 1L, {hub}, {gap}, 3L, false, false), (2L, 'two', 80, 0L, 0L, null, 0L, null, null, 0L, true, true), (null, 'none', 5, 0L, 0L, null, 0L, null, null, 0L, false, false)
        as t(repo_id, full_name, score, node_count, cycles_count, sample_cycle, breaking_count, top_hub, first_unresolved, unresolved_count, has_tests, has_ci)""")  # fmt: skip
    scores = scoring.with_findings(rows)
    one, two = scoring.run_records(scores, "head", F.lit(0)).orderBy("repo_id").collect()
    listed = scoring.findings(rows).where("repo_id = 1").orderBy("rule").collect()
    assert [r.rule for r in listed] == [1, 2, 3, 4, 5, 6]
    assert [tuple(x.values()) for x in json.loads(one.findings)] == [(r.severity, r.title, r.what) for r in listed]
    assert list(json.loads(one.findings)[0]) == ["severity", "title", "what_to_do"]
    assert one.do_this_first == [r.what for r in listed[:3]] and "6 actionable findings identified across 7 files." in one.executive_summary
    assert (two.findings, two.do_this_first) == ("[]", [scoring.NOTHING_TO_DO]) and "0 actionable findings" in two.executive_summary
    assert two.sub_scores == '{"structure":90,"dependency":null,"change_safety":70,"verification":75}'
    summed = {r.repo_id: r for r in scoring.summaries(scores).collect()}
    assert set(summed) == {1, 2, None} and "0 actionable findings" in summed[None].executive_summary and summed[None].do_this_first == [scoring.NOTHING_TO_DO]
