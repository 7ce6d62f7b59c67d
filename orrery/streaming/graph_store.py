"""A stored graph that pushes are folded into.

Every table is partitioned by ``part``, a hash of the repository, so a push reads and
replaces the parts of its repositories only (dynamic partition overwrite).  Nodes are
replaced last: they hold the hashes by which a push is told to be new, so a push that was
broken off is done anew when it comes again, and one that was done changes nothing.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .graph_updates import Graph, Increment, full_build, incremental

PARTS = 64


class GraphStore:
    """``path`` is a folder that driver and executors share; ``parts`` stays as it was when the graph was built."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def part(self) -> Column:
        return F.pmod(F.xxhash64("repo_id"), F.lit(self.parts)).cast("int")

    def _write(self, graph: Graph, parts: list[int], names: tuple[str, ...] = Graph._fields) -> None:
        """The edges, then the other tables side by side, then the nodes: edges are made from all the old tables, each other one from its own and the push.

        Only partitions with rows are replaced, so each part gets a row of nulls, too.
        A part is one file unless it is large.
        """
        marks = self.spark.createDataFrame([(part,) for part in parts], "part int")

        def write(name: str) -> None:
            rows = getattr(graph, name).withColumn("part", self.part()).unionByName(marks, allowMissingColumns=True)
            rows.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")

        write("edges")
        with ThreadPoolExecutor(len(Graph._fields)) as pool:
            list(pool.map(write, [name for name in names if name not in ("edges", "nodes")]))
        write("nodes")

    def build(self, tree: DataFrame) -> None:
        """Stores the graph of all files (repo_id, path, content); the folder must be new."""
        self._write(full_build(tree), list(range(self.parts)))

    def graph(self, parts: list[int] | None = None, kind: str | None = None) -> Graph:
        """The stored graph, or some of its parts; ``kind``, the type of repo_id, spares a look into the files."""
        tables = []
        for name, columns in Graph.columns().items():
            reader = self.spark.read.schema(f"repo_id {kind}, {columns}") if kind else self.spark.read
            paths = [f"{self.path}/{name}"] if parts is None else [f"{self.path}/{name}/part={part}" for part in parts]
            tables.append(reader.parquet(*paths).where("repo_id is not null").select("repo_id", *(c.split()[0] for c in columns.split(", "))))
        return Graph(*tables)

    def after(self, tree: DataFrame, removed: DataFrame) -> tuple[Increment, list[int]]:
        """What a push changes, and the parts that it touches; nothing is stored."""
        keys = tree.select("repo_id").union(removed.select("repo_id")).select(self.part().alias("part")).distinct()
        parts = sorted(r.part for r in keys.collect())  # at most ``self.parts``
        return incremental(self.graph(parts, tree.schema["repo_id"].dataType.simpleString()), tree, removed) if parts else None, parts

    def push(self, tree: DataFrame, removed: DataFrame) -> list[int]:
        """Folds a push (added and modified files; removed ones) in; returns the parts it has replaced."""
        increment, parts = self.after(tree, removed)
        if parts:
            self._write(increment.graph, parts, increment.changed)
        return parts
