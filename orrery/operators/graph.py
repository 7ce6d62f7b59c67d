"""Measures of import graphs: nodes (repo_id, path), edges (repo_id, source_path, target_path)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import written
from . import components

# Extensions that never count as orphans.
PASSIVE_EXTENSIONS = (".md", ".json", ".yaml", ".yml", ".txt", ".toml", ".svg", ".png")
EDGES_IN_TASK, LARGE = 200_000, 1000


def folder(path: str):
    return F.regexp_replace(path, "/?[^/]*$", "")


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    source, target = nodes.select("repo_id", F.col("path").alias("source_path")), nodes.select("repo_id", F.col("path").alias("target_path"))
    return edges.join(source, ["repo_id", "source_path"], "left_semi").join(target, ["repo_id", "target_path"], "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out per node; repeated edges count each time.  One shuffle: both ends are summed together."""
    ends = edges.select("repo_id", F.explode(F.array(F.struct(F.col("target_path").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_path").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    sums = ends.groupBy("repo_id", "e.path").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return nodes.join(sums, ["repo_id", "path"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "fan_out")})


def hubs(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Each repository's ``n`` nodes of highest fan-in above 0; critical above 30."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("fan_in"), "path"))
    top = degrees(nodes, edges).where("fan_in > 0").withColumn("rank", rank).where(F.col("rank") <= n)
    return top.select("repo_id", "rank", "path", "fan_in", "fan_out", (F.col("fan_in") > 30).alias("critical"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without edges, but for passive files.  A null extension may be an orphan."""
    return degrees(nodes, edges).where((F.col("fan_in") + F.col("fan_out") == 0) & ~F.coalesce(F.col("ext").isin(*PASSIVE_EXTENSIONS), F.lit(False))).select("repo_id", "path")


def bounded_lists(nodes: DataFrame, edges: DataFrame, n_orphans: int = 25, n_unresolved: int = 20) -> DataFrame:
    """The first orphans and the first files with unresolved specifiers of each repository, in path order: (repo_id, kind, path, place)."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))
    first = lambda rows, kind, n: rows.select("repo_id", F.lit(kind).alias("kind"), "path", place.alias("place")).where(F.col("place") <= n)
    return first(orphans(nodes, edges), "orphan", n_orphans).union(first(nodes.where("unresolved > 0"), "unresolved", n_unresolved))


def coupling(edges: DataFrame) -> DataFrame:
    """Per repository: edges, those across folders, and their share to three decimals."""
    across = F.count_if(folder("source_path") != folder("target_path"))
    return edges.groupBy("repo_id").agg(F.count("*").alias("edge_count"), across.alias("cross_folder"), F.bround(across / F.count("*"), 3).alias("coupling_ratio"))


def neighbors(edges: DataFrame) -> DataFrame:
    """Distinct sorted neighbours of every node that has any, joined by commas."""
    ends = edges.select("repo_id", F.explode(F.array(F.struct(F.col("source_path").alias("path"), F.col("target_path").alias("t"), F.lit(None).cast("string").alias("s")), F.struct(F.col("target_path").alias("path"), F.lit(None).cast("string").alias("t"), F.col("source_path").alias("s")))).alias("e"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return ends.groupBy("repo_id", "e.path").agg(joined("e.t").alias("imports"), joined("e.s").alias("imported_by"))


def neighbors_of(asked: DataFrame, edges: DataFrame, states: DataFrame, documents: DataFrame) -> DataFrame:
    """Sorted neighbours of the paths asked for (repo_id, path; slashes of either kind).

    Repositories without a state (repo_id) fall back, for paths without any
    edge, on the edges in their latest ready document (repo_id, id, status,
    created_at, edges: array of source and target).
    """
    norm = asked.select("repo_id", F.regexp_replace(F.translate(F.col("path"), "\\", "/"), "^/+", "").alias("path")).distinct()
    ends = lambda e: neighbors(e.join(norm.select("repo_id").distinct(), "repo_id", "left_semi"))
    rows = norm.join(ends(edges), ["repo_id", "path"], "left")
    stated = states.select("repo_id").distinct().withColumn("stated", F.lit(True))
    last = documents.where("status = 'ready'").join(stated, "repo_id", "left_anti").groupBy("repo_id").agg(F.max_by("edges", F.struct("created_at", "id")).alias("edges"))
    kept = last.select("repo_id", F.explode("edges").alias("e")).where("e.source is not null and e.source <> '' and e.target is not null and e.target <> ''")
    old = ends(kept.select("repo_id", F.col("e.source").alias("source_path"), F.col("e.target").alias("target_path"))).select("repo_id", "path", F.col("imports").alias("old_imports"), F.col("imported_by").alias("old_imported_by"))
    rows = rows.join(old, ["repo_id", "path"], "left")
    pick = lambda c: F.coalesce(F.when(F.col("imports").isNull() & F.col("imported_by").isNull(), F.col(f"old_{c}")).otherwise(F.col(c)), F.lit(""))
    return rows.select("repo_id", "path", pick("imports").alias("imports"), pick("imported_by").alias("imported_by"))


def folder_closure(nodes: DataFrame) -> DataFrame:
    """Every ancestor folder with its parent (null for the root, '') and depth."""
    parts = F.split("path", "/")
    every = nodes.select("repo_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder")).distinct()
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return every.select("repo_id", "folder", F.when(F.col("folder") == "", F.lit(None)).otherwise(folder("folder")).alias("parent"), depth.alias("depth"))


def _components(paths: list[str], adjacent: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    place: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for root in paths:
        if root in index:
            continue
        work = [(root, iter(adjacent.get(root, ())))]
        index[root] = low[root] = len(index)
        place[root] = len(stack)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    place[other] = len(stack)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(adjacent.get(other, ()))))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = place[node]
                    out.append(stack[at:])
                    on -= set(stack[at:])
                    del stack[at:]
    return out


def _chain(paths: list[str], adjacent: dict[str, list[str]]) -> list[str]:
    """The longest path of an acyclic graph, the least in text order among equals."""
    waiting = {p: 0 for p in paths}
    for p in paths:
        for q in adjacent.get(p, ()):
            waiting[q] += 1
    ready, order = sorted((p for p in paths if not waiting[p]), reverse=True), []
    while ready:
        p = ready.pop()
        order.append(p)
        for q in adjacent.get(p, ()):
            waiting[q] -= 1
            if not waiting[q]:
                ready.append(q)
    length: dict[str, int] = {}
    following: dict[str, str] = {}
    for p in reversed(order):
        best = min(adjacent.get(p, ()), key=lambda q: (-length[q], q), default=None)
        length[p] = 1 + (length[best] if best else 0)
        if best:
            following[p] = best
    if not length:
        return []
    at = min(length, key=lambda p: (-length[p], p))
    chain = [at]
    while at in following:
        at = following[at]
        chain.append(at)
    return chain


def cycles_and_chains(edges: DataFrame, in_task: int = EDGES_IN_TASK) -> DataFrame:
    """Per repository: cycles (components of several nodes, or self-loops), their nodes, the one with the least node, and the longest chain without them.

    A repository of at most ``in_task`` edges goes to one task; larger ones are
    measured together by ``components``, whose tables no task holds whole.  Both
    give the same rows.
    """
    large = [r.repo_id for r in edges.groupBy("repo_id").count().where(F.col("count") > in_task).select("repo_id").limit(LARGE + 1).collect()]
    if len(large) > LARGE:  # too many to name: all of them are measured together
        return components.cycles_and_chains(edges)
    if large:
        inside = F.col("repo_id").isin(large)
        return components.cycles_and_chains(edges.where(inside)).unionByName(_small_cycles_and_chains(edges.where(~inside)))
    return _small_cycles_and_chains(edges)


def _small_cycles_and_chains(edges: DataFrame) -> DataFrame:

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(set(zip(pdf.source_path, pdf.target_path, strict=True)))
        adjacent: dict[str, list[str]] = {}
        for a, b in pairs:
            adjacent.setdefault(a, []).append(b)
        paths = sorted({x for p in pairs for x in p})
        loops = {a for a, b in pairs if a == b}
        cycles = sorted(sorted(c) for c in _components(paths, adjacent) if len(c) > 1 or c[0] in loops)
        inside = {x for c in cycles for x in c}
        free = {a: [b for b in bs if b not in inside] for a, bs in adjacent.items() if a not in inside}
        chain = _chain([p for p in paths if p not in inside], free)
        return pd.DataFrame({"repo_id": [pdf.repo_id.iloc[0]], "cycles_count": [len(cycles)], "cycle_nodes": [",".join(sorted(inside))], "sample_cycle": [",".join(cycles[0]) if cycles else None], "chain_depth": [len(chain)], "chain": [",".join(chain)]})

    kind = edges.schema["repo_id"].dataType.simpleString()
    return edges.select("repo_id", "source_path", "target_path").groupBy("repo_id").applyInPandas(run, f"repo_id {kind}, cycles_count long, cycle_nodes string, sample_cycle string, chain_depth long, chain string")


def blast_radius(edges: DataFrame, seeds: DataFrame, max_hops: int = 3) -> DataFrame:
    """Files that reach a seed (repo_id, path) through imports within ``max_hops``, with the least distance.

    Each front is a table and holds only files that no earlier one has.
    """
    back = edges.select("repo_id", F.col("target_path").alias("path"), F.col("source_path").alias("next"))
    found = front = written(seeds.select("repo_id", "path", F.lit(0).alias("hops")).distinct(), "front")
    for hop in range(1, max_hops + 1):
        reached = front.join(back, ["repo_id", "path"]).select("repo_id", F.col("next").alias("path")).distinct()
        front = written(reached.join(found.select("repo_id", "path"), ["repo_id", "path"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        found = found.union(front)
        if front.isEmpty():
            break
    return found


def layout_anchors(folders: DataFrame) -> DataFrame:
    """Polar anchors of folders around their parents, the root in the middle.

    Radius 4.8 + 0.85 per sibling, the circle divided among siblings in text
    order, 4.8 down per level.  A place is the sum of the offsets of a folder and
    its ancestors, found by an equi-join on the ancestors' names.
    """
    siblings = Window.partitionBy("repo_id", "parent")
    ranked = folders.withColumn("rank", F.row_number().over(siblings.orderBy("folder")) - 1).withColumn("siblings", F.count("*").over(siblings))
    angle = 2 * F.pi() * F.col("rank") / F.col("siblings")
    radius = F.when(F.col("parent").isNull(), 0.0).otherwise(4.8 + 0.85 * F.col("siblings"))
    offsets = ranked.select("repo_id", F.col("folder").alias("ancestor"), (radius * F.cos(angle)).alias("dx"), (radius * F.sin(angle)).alias("dz"))
    parts = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    placed = ranked.select("repo_id", "folder", F.explode(chain).alias("ancestor")).join(offsets, ["repo_id", "ancestor"])
    sums = placed.groupBy("repo_id", "folder").agg(F.round(F.sum("dx"), 5).alias("x"), F.round(F.sum("dz"), 5).alias("z"))
    return ranked.join(sums, ["repo_id", "folder"]).select("repo_id", "folder", "rank", "siblings", "x", F.round(-4.8 * F.col("depth"), 5).alias("y"), "z")


def node_seeds(nodes: DataFrame) -> DataFrame:
    """Places of files around their folder's anchor: rank, tier of ten, radius and angle."""
    own = Window.partitionBy("repo_id", "folder")
    ranked = nodes.withColumn("folder", folder("path")).withColumn("rank", F.row_number().over(own.orderBy("path")) - 1).withColumn("files", F.count("*").over(own))
    ring = F.greatest(F.lit(2.6), F.ceil(F.sqrt("files")) * 1.6)
    tier = F.floor(F.col("rank") / 10)
    return ranked.select("repo_id", "path", "rank", tier.alias("tier"), F.round(ring + tier * 2.2, 5).alias("radius"), F.round(2 * F.pi() * F.col("rank") / F.col("files"), 5).alias("angle"))


def wire_midpoint(x1: str, y1: str, z1: str, x2: str, y2: str, z2: str):
    """Height of an edge's middle: sagging between layers (over 1.2 apart), arched within one."""
    dx, dy, dz = (F.col(b) - F.col(a) for a, b in ((x1, x2), (y1, y2), (z1, z2)))
    flat = F.hypot(dx, dz)
    middle = (F.col(y1) + F.col(y2)) * 0.5
    sag = F.least(F.lit(1.2), F.greatest(F.lit(0.25), flat * 0.1))
    arch = F.least(F.lit(1.8), F.greatest(F.lit(0.35), F.hypot(flat, dy) * 0.15))
    return F.when(F.abs(dy) > 1.2, middle - sag).otherwise(middle + arch)


def wire_middle(x1: str, y1: str, z1: str, x2: str, y2: str, z2: str):
    """struct(x, y, z) of an edge's middle: half-way but for its height."""
    half = lambda a, b: (F.col(a) + F.col(b)) * 0.5
    return F.struct(half(x1, x2).alias("x"), wire_midpoint(x1, y1, z1, x2, y2, z2).alias("y"), half(z1, z2).alias("z"))


def latest_ready(graphs: DataFrame) -> DataFrame:
    """``graphs``: id, repo_id, status, created_at.  The last ready one of each repository."""
    return graphs.where("status = 'ready'").groupBy("repo_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("graph_id"))


def relaxed(points: DataFrame, ticks: int = 100, reach: float = 1.6, pull: float = 0.05) -> DataFrame:
    """Files pushed apart within each folder and pulled to its anchor, y fixed: (repo_id, folder, path, x, z, tx, tz).

    Each folder is relaxed alone; intake bounds its files.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xz, to = pdf[["x", "z"]].to_numpy(float).copy(), pdf[["tx", "tz"]].to_numpy(float)
        for _ in range(ticks):
            apart = xz[:, None] - xz[None]
            far = np.sqrt((apart**2).sum(-1))
            push = np.where((far > 0) & (far < reach), (reach - far) / np.maximum(far, 1e-9) * 0.5, 0.0)
            xz += (apart * push[..., None]).sum(1) * 0.5 + (to - xz) * pull
        return pdf[["repo_id", "folder", "path"]].assign(x=xz[:, 0], z=xz[:, 1])

    kind = points.schema["repo_id"].dataType.simpleString()
    return points.groupBy("repo_id", "folder").applyInPandas(run, f"repo_id {kind}, folder string, path string, x double, z double")


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document per repository: nodes, edges and counts, as JSON in path order."""
    n = nodes.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), folder("path").alias("dir"), "ext"))).alias("nodes"))
    e = edges.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct(F.col("source_path").alias("source"), F.col("target_path").alias("target")))).alias("edges"))
    none = F.array().cast(e.schema["edges"].dataType)
    rows = n.join(e, "repo_id", "left").withColumn("edges", F.coalesce("edges", none))
    return rows.select("repo_id", F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"), F.to_json(F.struct("nodes", "edges")).alias("graph_json"))


def freshness(graphs: DataFrame, states: DataFrame, now: str, refresh: bool = False) -> DataFrame:
    """Status and mode of stored graphs.

    ``graphs``: repo_id, commit_sha, status, created_at, build_mode; ``states``: repo_id,
    last_full_scan_sha.  One that has been computing for over 120 seconds is stale.
    A ready one is full if it is asked for anew, else what its document says,
    else incremental if the last full scan was of another commit.
    """
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    rows = graphs.join(states.select("repo_id", "last_full_scan_sha"), "repo_id", "left")
    scanned = F.nullif("last_full_scan_sha", F.lit(""))
    mode = F.lit("full") if refresh else F.coalesce("build_mode", F.when(scanned != F.col("commit_sha"), "incremental").otherwise("full"))
    return rows.select("repo_id", "commit_sha", F.when((F.col("status") == "computing") & (age > 120), "stale").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "ready", mode).alias("mode"))
