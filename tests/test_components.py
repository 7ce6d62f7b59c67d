"""Cycles and chains without a task per repository, against the search in one task."""

import random

import pytest

from orrery.operators import components, graph

EDGE = "repo_id string, source_path string, target_path string"


def test_equal_to_the_search_in_a_task(spark):
    rnd, rows = random.Random(7), []
    for repo in range(8):
        n = rnd.randint(2, 14)
        rows += [(f"r{repo}", f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(rnd.randint(1, 2 * n))]
    rows += [("loops", "a", "a"), ("loops", "a", "b"), ("into", "x", "c1"), ("into", "c1", "c2"), ("into", "c2", "c1"), ("all", "a", "b"), ("all", "b", "a")]
    rows += [("ring", f"n{i:02}", f"n{(i + 1) % 30:02}") for i in range(30)] + [("line", f"n{i:02}", f"n{i + 1:02}") for i in range(12)]
    edges = spark.createDataFrame(rows, EDGE)
    want = {r.repo_id: tuple(r) for r in graph.cycles_and_chains(edges).collect()}
    assert {r.repo_id: tuple(r) for r in components.cycles_and_chains(edges).select(*graph.cycles_and_chains(edges).columns).collect()} == want


def test_large_repositories_are_told_apart(spark):
    edges = spark.createDataFrame([("big", "a", "b"), ("big", "b", "a"), ("big", "b", "c"), ("small", "x", "y")], EDGE)
    got = {r.repo_id: (r.cycles_count, r.cycle_nodes, r.chain_depth) for r in graph.cycles_and_chains(edges, in_task=2).collect()}
    assert got == {"big": (1, "a,b", 1), "small": (0, "", 2)}
    assert graph.cycles_and_chains(edges.limit(0)).count() == 0
    assert components.strong_components(edges.limit(0)).count() == 0


def test_chains_refuse_cycles(spark):
    with pytest.raises(ValueError, match="cycles"):
        components.longest_chains(spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c")], EDGE)).collect()
