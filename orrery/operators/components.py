"""Cycles and longest chains of graphs of any size, on DataFrames.

``strong_components`` trims nodes that no cycle can pass, colours the rest with the least
node that reaches them, then with the least one that they reach in their colour; where
both agree they share a component.  ``longest_chains`` peels an acyclic graph level by level from
its sinks.  Both work on all repositories at once; every round is a table in the shared
folder, so a lost executor costs one round.

Edges: (repo_id, source_path, target_path).  Repeated edges count once; nulls are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import written

S, T = ["repo_id", "s"], ["repo_id", "t"]


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.col("source_path").alias("s"), F.col("target_path").alias("t")).dropna().distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that start where one ends and end where one starts, again and again while many go."""
    left = edges.count()
    while left:
        edges = written(edges.join(edges.select("repo_id", F.col("t").alias("s")).distinct(), S, "left_semi").join(edges.select("repo_id", F.col("s").alias("t")).distinct(), T, "left_semi"), "trimmed")
        before, left = left, edges.count()
        if left > 0.95 * before:
            break
    return edges


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(repo_id, v, c): the least node from which each node is reached, itself included.

    A node takes the least label of its neighbours' and then that label's own label,
    so labels travel paths in steps that grow.
    """
    colours = edges.select("repo_id", F.explode(F.array("s", "t")).alias("v")).distinct().withColumn("c", F.col("v"))
    while True:
        own = colours.select("repo_id", "v", "c", F.col("c").alias("old"))
        come = edges.join(colours.select("repo_id", F.col("v").alias("s"), "c"), S).select("repo_id", F.col("t").alias("v"), "c", F.lit(None).cast("string").alias("old"))
        stepped = written(own.union(come).groupBy("repo_id", "v").agg(F.min("c").alias("c"), F.min("old").alias("old")), "stepped")
        labels = stepped.select("repo_id", F.col("v").alias("c"), F.col("c").alias("further"))
        jumped = written(stepped.join(labels, ["repo_id", "c"]).select("repo_id", "v", F.least("c", "further").alias("c"), "old"), "coloured")
        colours = jumped.select("repo_id", "v", "c")
        if jumped.where("c < old").isEmpty():
            return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """(repo_id, path, component) of the nodes in components of several nodes; ``component`` is its least node."""
    left = _trimmed(written(_ends(edges).where("s <> t"), "ends"))
    found = left.sparkSession.createDataFrame([], f"repo_id {left.schema['repo_id'].dataType.simpleString()}, path string, component string")
    while not left.isEmpty():
        forward = _least_reaching(left)
        inner = left.join(forward.toDF("repo_id", "s", "cs"), S).join(forward.toDF("repo_id", "t", "ct"), T).where("cs = ct").select("repo_id", "s", "t")
        inner = written(inner, "inner")
        backward = _least_reaching(inner.select("repo_id", F.col("t").alias("s"), F.col("s").alias("t")))
        met = written(forward.join(backward.withColumnRenamed("c", "b"), ["repo_id", "v"]).where("c = b").select("repo_id", F.col("v").alias("path"), F.col("c").alias("component")), "components")
        several = met.where("path <> component").select("repo_id", "component").distinct()
        found = found.union(met.join(several, ["repo_id", "component"], "left_semi").select("repo_id", "path", "component"))
        left = _trimmed(written(inner.join(met.select("repo_id", F.col("path").alias("s")), S, "left_anti").join(met.select("repo_id", F.col("path").alias("t")), T, "left_anti"), "left"))
    return found


def longest_chains(edges: DataFrame) -> DataFrame:
    """(repo_id, chain_depth, chain): the longest path of each repository's acyclic graph, the least in text order among equals, with its nodes joined by commas."""
    left = written(_ends(edges), "chain-edges")
    every = left.select("repo_id", F.explode(F.array("s", "t")).alias("v")).distinct()
    front = written(every.join(left.select("repo_id", F.col("s").alias("v")).distinct(), ["repo_id", "v"], "left_anti").select("repo_id", "v", F.lit(None).cast("string").alias("next"), F.lit(1).alias("level")), "level")
    if front.isEmpty() and not left.isEmpty():
        raise ValueError("the graph has cycles")
    levels, depth = [front], 1
    while not left.isEmpty():
        depth += 1
        met = left.join(front.select("repo_id", F.col("v").alias("t")), T, "left_semi")
        rest = written(left.join(front.select("repo_id", F.col("v").alias("t")), T, "left_anti"), "chain-edges")
        new = met.groupBy("repo_id", F.col("s").alias("v")).agg(F.min("t").alias("next")).join(rest.select("repo_id", F.col("s").alias("v")).distinct(), ["repo_id", "v"], "left_anti")
        front = written(new.withColumn("level", F.lit(depth)), "level")
        if front.isEmpty():
            raise ValueError("the graph has cycles")
        left = rest
        levels.append(front)
    deepest = levels[0].select("repo_id", "level", "v", "next")
    for rows in levels[1:]:
        deepest = deepest.union(rows.select("repo_id", "level", "v", "next"))
    at = deepest.groupBy("repo_id").agg(F.min(F.struct((-F.col("level")).alias("level"), "v", "next")).alias("top")).select("repo_id", (-F.col("top.level")).alias("chain_depth"), F.col("top.v").alias("chain"), F.col("top.next").alias("next"))
    for rows in reversed(levels[:-1]):  # one row per repository takes the next node from each level below its own
        step = rows.select("repo_id", F.col("v").alias("next"), F.col("next").alias("_after"), F.lit(True).alias("_met"))
        at = at.join(step, ["repo_id", "next"], "left").select("repo_id", "chain_depth", F.when(F.col("_met"), F.concat_ws(",", "chain", "next")).otherwise(F.col("chain")).alias("chain"), F.when(F.col("_met"), F.col("_after")).otherwise(F.col("next")).alias("next"))
        if len(levels) > 8:
            at = written(at, "chain")
    return at.select("repo_id", "chain_depth", "chain")


def cycles_and_chains(edges: DataFrame) -> DataFrame:
    """As ``graph.cycles_and_chains``, for repositories of any size."""
    members = written(strong_components(edges), "members")
    loops = edges.where("source_path = target_path").select("repo_id", F.col("source_path").alias("path")).distinct()
    alone = loops.join(members.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select("repo_id", "path", F.col("path").alias("component"))
    inside = written(members.union(alone), "cycle-nodes")
    per = inside.groupBy("repo_id", "component").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("nodes"))
    cycles = per.groupBy("repo_id").agg(F.count("*").alias("cycles_count"), F.min_by("nodes", "component").alias("sample_cycle"))
    every = inside.groupBy("repo_id").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("cycle_nodes"))
    free = edges
    for end in ("source_path", "target_path"):
        free = free.join(inside.select("repo_id", F.col("path").alias(end)), ["repo_id", end], "left_anti")
    # Nodes outside of cycles whose edges all end or start in them are chains of one.
    nodes = edges.select("repo_id", F.explode(F.array("source_path", "target_path")).alias("path")).dropna().distinct()
    lone = nodes.join(inside.select("repo_id", "path"), ["repo_id", "path"], "left_anti").groupBy("repo_id").agg(F.min("path").alias("_lone"))
    rows = nodes.select("repo_id").distinct().join(cycles, "repo_id", "left").join(every, "repo_id", "left").join(longest_chains(free), "repo_id", "left").join(lone, "repo_id", "left")
    depth = F.coalesce("chain_depth", F.when(F.col("_lone").isNotNull(), 1).otherwise(0)).cast("long")
    return rows.select("repo_id", F.coalesce("cycles_count", F.lit(0)).cast("long").alias("cycles_count"), F.coalesce("cycle_nodes", F.lit("")).alias("cycle_nodes"), "sample_cycle", depth.alias("chain_depth"), F.coalesce("chain", "_lone", F.lit("")).alias("chain"))
