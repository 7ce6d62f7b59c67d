"""Stored graphs: pushes against full builds, replays, broken-off pushes, Go's imports by parts of paths."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import imports
from orrery.plans import fixtures
from orrery.streaming import graph_store, graph_updates

TREE = "repo_id string, path string, content string"
GO = [
    ("g", "cmd/main.go", 'import (\n\t"fmt"\n\t"acme/pkg/util"\n\tu "util/a"\n)\n'), ("g", "pkg/util/a.go", 'import "main"\n'), ("g", "acme/pkg/util/z.go", ""), ("g", "docs/main.md", ""),
    ("h", "main.go", 'import "ai"\n'), ("h", "io/fmt.go", 'import "../main"\n'),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, TREE).withColumn("content", F.encode("content", "UTF-8"))


def tables(graph):
    return [sorted(map(str, t.collect())) for t in graph]


def test_go_imports_by_parts_of_paths(spark):
    """The first path of the repository that holds the specifier anywhere."""
    graph = graph_updates.full_build(frame(spark, GO))
    got = {(r.repo_id, r.source_path, r.target_path) for r in graph.edges.collect()}
    assert got == {("g", "cmd/main.go", "acme/pkg/util/z.go"), ("g", "cmd/main.go", "pkg/util/a.go"), ("g", "pkg/util/a.go", "cmd/main.go"), ("h", "io/fmt.go", "main.go")}
    assert "Contains(" not in graph.edges._jdf.queryExecution().optimizedPlan().toString()


def test_go_join_makes_no_pairs(spark):
    """A common specifier and many paths that hold it meet in one row each."""
    specs = spark.range(3000).selectExpr("1 as repo_id", "concat('f', id, '.go') as path", "'go' as language", "'common' as spec")
    known = spark.range(3000).selectExpr("1 as repo_id", "concat('common/f', id, '.go') as target_path")
    found = imports.inside_paths(specs, known)
    assert found.count() == 3000 and {r.target_path for r in found.select("target_path").distinct().collect()} == {"common/f0.go"}


def test_specifiers_are_joined_once(spark):
    """A specifier makes one row for each base, not one for each suffix, and means what trying all suffixes in order means."""
    known = ["src/a.ts", "src/a/index.ts", "src/a.js", "src/b.jsx", "src/b.mjs", "src/c/index.jsx", "src/d", "src/d.ts", "p/x.py", "p/x/__init__.py", "p/y/__init__.py", "src/m.rs", "m.rs", "m/mod.rs", "n/mod.rs", "c/u.h", "c/u.hpp", "j/K.java", "j/K.rb"]
    asked = [("typescript", "src/z.ts", "./a"), ("tsx", "src/z.tsx", "./b"), ("javascript", "src/z.js", "./c"), ("javascript", "src/z.js", "./d"), ("javascript", "src/z.js", "./none"), ("python", "p/z.py", ".x"), ("python", "p/z.py", "p.y"), ("python", "p/z.py", "..p"), ("rust", "z.rs", "crate::m"), ("rust", "z.rs", "crate::n"), ("c", "c/z.c", "u"), ("c", "c/z.c", "u.hpp"), ("java", "j/Z.java", "./K")]
    want = {"./a": "src/a.ts", "./b": "src/b.jsx", "./c": "src/c/index.jsx", "./d": "src/d", ".x": "p/x.py", "p.y": "p/y/__init__.py", "crate::m": "src/m.rs", "crate::n": "n/mod.rs", "u": "c/u.h", "u.hpp": "c/u.hpp", "./K": "j/K.java"}
    specs = spark.createDataFrame([(1, *x) for x in asked], "repo_id long, language string, path string, spec string")
    paths = spark.createDataFrame([(1, p) for p in [*known, *known[:2]]] + [(2, "src/none.ts")], "repo_id long, target_path string")
    assert imports.bases(specs, None).count() == len(asked) + 2  # Rust's crate has two bases
    found = imports.direct_hits(specs, None, paths).collect()
    assert {r.spec: r.target_path for r in found} == want and len(found) == len(want)


def test_nearest_path_map(spark):
    """Of two tsconfig files above a file the nearer one counts, of its maps the first that leads to a path."""
    specs = spark.createDataFrame([(1, "typescript", "app/web/x.ts", "@/a"), (1, "typescript", "lib/x.ts", "@/a"), (2, "typescript", "x.ts", "@/a")], "repo_id long, language string, path string, spec string")
    maps = spark.createDataFrame([(1, "", "@", "src", 0), (1, "app", "@", "app/none", 0), (1, "app", "@", "app/src", 1), (1, "app", "@", "app/old", 2), (1, "ap", "@", "src", 0)], "repo_id long, config_dir string, prefix string, target string, place int")
    paths = spark.createDataFrame([(1, "src/a.ts"), (1, "app/old/a.ts"), (1, "app/src/a/index.tsx"), (2, "src/a.ts")], "repo_id long, target_path string")
    assert {(r.path, r.target_path) for r in imports.direct_hits(specs, maps, paths).collect()} == {("app/web/x.ts", "app/src/a/index.tsx"), ("lib/x.ts", "src/a.ts")}


def test_names_are_made_distinct_where_files_are_read(spark):
    """The index of names takes no shuffle, and has each name of a file once."""
    parsed = spark.createDataFrame([("r", "a.go", "go", [("x/y.go",), ("z/y.go",)]), ("r", "b.ts", "typescript", [("./y",), ("..",), ("./y",)]), ("r", "c.md", None, [])], "repo_id string, path string, language string, specs array<struct<spec:string>>")
    found = graph_updates.tokens_of(parsed)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("y.go", False), ("y", False), ("go", False), ("x/y.go", True), ("z/y.go", True)]
    got = sorted((r.path, r.name, r.is_go) for r in found.collect())
    assert got == sorted([("a.go", *w) for w in want] + [("b.ts", n, False) for n in ("y", "..", ".", "")])


@pytest.mark.parametrize("seed", [1, 2])
def test_pushes_are_full_builds(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(f"r{n}", p, t) for n in range(2) for _, p, t in fixtures.TREE] + GO
    store = graph_store.GraphStore(spark, str(tmp_path / "graph"), parts=4)
    now = {(r, p): t for r, p, t in rows if rnd.random() < 0.7}
    store.build(frame(spark, [(*k, t) for k, t in now.items()]))
    for _ in range(2):
        gone = [k for k in now if rnd.random() < 0.2]
        come = {(r, p): t + ("\n" if rnd.random() < 0.5 else "") for r, p, t in rows if rnd.random() < 0.3 and (r, p) not in gone}
        push = frame(spark, [(*k, t) for k, t in come.items()]), spark.createDataFrame(gone, "repo_id string, path string")
        now = {k: t for k, t in (now | come).items() if k not in gone}
        store.push(*push)
        after = tables(store.graph())
        assert after == tables(graph_updates.full_build(frame(spark, [(*k, t) for k, t in now.items()])))
        store.push(*push)  # a replay changes nothing
        assert tables(store.graph()) == after


def test_broken_off_push_is_done_again(spark, tmp_path):
    store = graph_store.GraphStore(spark, str(tmp_path / "graph"), parts=4)
    store.build(frame(spark, [x for x in fixtures.TREE if x[1] != "src/b.tsx"]))
    added, none = frame(spark, [x for x in fixtures.TREE if x[1] == "src/b.tsx"]), spark.createDataFrame([], "repo_id string, path string")
    increment, parts = store.after(added, none)
    old = [tuple(r) for r in store.graph(parts, "string").nodes.collect()]
    store._write(increment.graph._replace(nodes=spark.createDataFrame(old, store.graph().nodes.schema)), parts)  # as if the nodes had not been reached
    store.push(added, none)
    assert tables(store.graph()) == tables(graph_updates.full_build(frame(spark, fixtures.TREE)))
    assert store.push(added.limit(0), none) == []
    store.push(added.limit(0), frame(spark, fixtures.TREE).select("repo_id", "path"))  # nothing is left, in the tables either
    assert all(t == [] for t in tables(store.graph()))
