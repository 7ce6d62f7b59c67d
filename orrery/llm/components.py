"""Connected components by alternating stars, with every round's edges written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``links``: (a, b).  Rows (node, component) for every linked node; the component is its least node.

    Large-star joins each node's larger neighbours to the least neighbour of it,
    small-star joins its smaller ones; both keep components and end in stars
    after a number of rounds that grows with the logarithm of their size.  No
    task gathers the neighbours of a node: minima are pre-aggregated and joined
    back, a join whose hot side Spark can split.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        edges = written(small, "links")
        last, state = state, _state(edges)
        if state == last:
            break
    else:
        raise RuntimeError(f"components: edges still change after {rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
