"""Near-duplicate documents by MinHash and an LSH forest, confirmed on full shingle sets.

A document's set holds the hashes of its distinct ``gram``-word shingles.  Equal
sets are one node.  A node's signature has ``TREES * STEP`` minima; tree t of the
forest sorts the signatures from place ``STEP * t`` on, cyclically.  Only nodes
that share ``whole_depth`` values with another take part in an order: that depth
loses at most ``MISS`` of the pairs at the threshold (7 values at 0.85: 1.1e-6; 6
at 0.80: 7.9e-6).  The orders are sorted over all partitions, and the longest
common prefixes of neighbours cut them into regions.  Inside a region nodes are
compared by their whole signatures, and those whose agreement is within 4.5
standard deviations of the threshold become candidates, each pair in the first
tree that brings it together only.

A region of more than ``CROWD`` nodes is cut deeper, each part as deep as it needs
up to ``DEEPEST`` values and then by place in the order, which finds most links of a
crowd cheaply but not all.  So crowded regions are compared again as wholes: what
the links so far have left outside a region's largest part meets first the nodes
of most links and then, block by block, all others of the region.  What is missed
is a pair in ``MISS`` by the depth and one in 300,000 by the 4.5 deviations.
Every candidate is confirmed on the full sets, region by region: what leaves the
first comparison is which nodes have candidates in which regions, not the pairs.
A node's set goes once to each such region, and pairs that the links found there
have connected already need no comparison.  Classes are the
connected components of the confirmed links.

Nulls and empty texts have an empty set and stay alone.  A null id is never
linked.  Texts with fewer words than a shingle have their whole sequence as one.
Repeated rows share a node; rows that repeat an id are one document for links.
A tie cannot arise: a class is named by its least id.  An empty table gives no
rows.  Very long texts are hashed in one pass, and their minima are taken 1024
shingles at a time.  Extra columns are ignored by ``classes`` and kept by
``deduplicated``, whatever their names; ids may be of any type that has an order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import by_arrow, partitions, written
from .components import components
from .kernels import Words, byte_table, grams, mix, slices, splitmix, text_view

SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
TABLE = byte_table(separators=SPACES, lower=True)
TREES, STEP, MISS = 48, 4, 1e-5
SIZE = TREES * STEP
DEEPEST, CROWD, KEPT = 24, 512, 0.75
DEALT, HUBS, SENT = 120, 8, 8 << 20
MULTIPLIERS = splitmix(SIZE, 3) | np.uint64(1)
GRAM, PERCENT = 5, 80


def shingle_sets(part: pa.RecordBatch, text: int, gram: int):
    """The sorted distinct shingle hashes of each row."""
    w = Words(*text_view(part.column(text)), TABLE, nul=True)
    hashes = grams(w.hash, gram)
    for first, n in zip(w.first.tolist(), w.count.tolist(), strict=True):
        if n >= gram:
            yield np.unique(hashes[first : first + n - gram + 1])
        elif n:
            yield grams(w.hash[first : first + n], n)
        else:
            yield np.zeros(0, np.uint64)


def signature(members: np.ndarray) -> bytes:
    """16 mixed bits of each minimum."""
    least = np.full(SIZE, np.iinfo(np.uint64).max)
    for at in range(0, len(members), 1024):
        np.minimum(least, (members[at : at + 1024] * MULTIPLIERS[:, None]).min(1), out=least)
    return mix(least).astype("<u2").tobytes()


def set_key(members: np.ndarray) -> bytes:
    """128 bits that do not depend on order."""
    with np.errstate(over="ignore"):
        return np.array([mix(members).sum(dtype=np.uint64), mix(members ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)]).tobytes()


def described(docs: DataFrame, id_column: str, gram: int) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            sets = list(shingle_sets(part, 1, gram))
            yield pa.record_batch(
                [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) if len(x) else None for x in sets], pa.binary()), pa.array([signature(x) if len(x) else None for x in sets], pa.binary())],
                names=["id", "n_shingles", "set_key", "signature"],
            )

    return by_arrow(docs.select(F.col(id_column).alias("id"), "text"), run, f"id {docs.schema[id_column].dataType.simpleString()}, n_shingles long, set_key binary, signature binary")


def missed(share: float, depth: int) -> float:
    """At most the chance that a pair of that similarity shares a prefix of ``depth`` values in no tree.

    Values are taken four at a time; a run counts from a tree's first value on.
    """
    chance = {0: 1.0}
    for _ in range(TREES):
        after = dict.fromkeys([0, *(r + STEP for r in chance)], 0.0)
        for run, c in chance.items():
            after[0] += c * sum(share**j * (1 - share) for j in range(STEP) if run + j < depth)
            if run + STEP < depth:
                after[run + STEP] += c * share**STEP
        chance = after
    return sum(chance.values())


def whole_depth(percent: int) -> int:
    """The longest prefix that loses at most ``MISS`` of the pairs at the threshold."""
    return max(d for d in range(STEP, DEEPEST) if d == STEP or missed(percent / 100, d) <= MISS)


def signed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with their nodes' signatures: one row for each node in the join, taken apart after it."""
    packed = rows.groupBy("id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "id"))).alias("rows"))
    return packed.join(nodes, "id").select("id", "signature", F.explode("rows").alias("r")).select("id", "signature", "r.*")


def values_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), SIZE)


def taken_apart(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | pa.Array, list[pa.Array]]:
    """Of rows whose last column is a list: row number and value of each element, and the other columns repeated to match."""
    lists = batch.column(batch.num_columns - 1)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    values = lists.flatten()
    return row, values if pa.types.is_struct(values.type) else values.to_numpy(zero_copy_only=False), [batch.column(i).take(pa.array(row)) for i in range(batch.num_columns - 1)]


def neighbours(nodes: DataFrame, percent: int) -> DataFrame:
    """(id, tree) of the nodes that share ``whole_depth`` values with another one in that tree's order.

    Range partitioning splits a key of any number of rows.  The first and the
    last row of a partition are kept in any case, as theirs may lie in the next one.
    """
    depth, kind = whole_depth(percent), nodes.schema["id"].dataType.simpleString()
    trees = np.arange(TREES)

    def prefixes(batches):
        for batch in batches:
            sigs, n = values_of(batch.column(1)), batch.num_rows
            key = mix(np.broadcast_to(trees.astype(np.uint64) + np.uint64(1), (n, TREES)))
            for d in range(depth):
                key = mix(key * np.uint64(0x9FB21C651E98DF25) ^ sigs[:, (STEP * trees + d) % SIZE])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))
            yield pa.record_batch([pa.array(key.ravel().view(np.int64)), ids, pa.array(np.tile(trees.astype(np.int32), n))], names=["key", "id", "tree"])

    rows = nodes.select("id", "signature").mapInArrow(prefixes, f"key long, id {kind}, tree int")
    rows = rows.repartitionByRange(partitions(rows), "key", "id").sortWithinPartitions("key")

    def run(batches):
        held, known = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            shared = np.concatenate([[known], same]) | np.concatenate([same, [False]])
            held, known = batch.slice(len(keys) - 1), bool(shared[-1])
            yield batch.slice(0, len(keys) - 1).filter(pa.array(shared[:-1])).select([1, 2])
        if held is not None:
            yield held.select([1, 2])

    return rows.mapInArrow(run, f"id {kind}, tree int")


def by_run(batches, depth: int, least: int = 1 << 15):
    """(rows, open left, open right) of parts of one sorted order; a part ends where fewer than ``depth`` values are common.

    A side is open where the rows there may belong to a run that goes on in
    another part: at a partition's ends and inside a run longer than ``least``.
    """
    held: list[pa.RecordBatch] = []
    left = True
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(x.num_rows for x in held) >= least:
            rows = pa.Table.from_batches(held).combine_chunks()
            ends = np.flatnonzero(common(rows) < depth)
            cut = int(ends[-1]) + 1 if len(ends) else rows.num_rows
            yield rows.slice(0, cut).combine_chunks(), left, not len(ends)
            left, held = not len(ends), rows.slice(cut).combine_chunks().to_batches()
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), left, True


def orders_of(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("order").to_pylist()), "<u2").reshape(rows.num_rows, DEEPEST)


def common(rows: pa.Table) -> np.ndarray:
    """The longest common prefix, in values, of each row and the next; -1 between trees."""
    order, tree = orders_of(rows), rows.column("tree").to_numpy()
    prefix = (order[1:] == order[:-1]).cumprod(axis=1, dtype=np.int8).sum(axis=1)
    return np.where(tree[1:] == tree[:-1], prefix, -1)


def cut_regions(rows: pa.Table, depth: int, left: bool, right: bool) -> tuple[np.ndarray, ...]:
    """(key, depth, whole, crowded) of each row of a sorted order; depth 0 where a row has no neighbour.

    A run of rows with ``depth`` common values is a region, ``whole``, if at
    most ``CROWD`` rows long; a longer one falls into runs of more common
    values, each as deep as it needs, and at last into neighbours by place.
    """
    n, prefix = rows.num_rows, common(rows)
    order, hashes = orders_of(rows), mix(rows.column("tree").to_numpy().astype(np.uint64) + np.uint64(1))
    key, level, whole, crowded = np.zeros(n, np.uint64), np.zeros(n, np.int8), np.zeros(n, np.uint64), np.zeros(n, bool)
    open_, place = np.ones(n, bool), np.arange(n)
    for d in range(1, DEEPEST + 1):
        hashes = mix(hashes * np.uint64(0x9FB21C651E98DF25) ^ order[:, d - 1])
        if d < depth:
            continue
        first = np.concatenate([[True], prefix < d])
        run = first.cumsum() - 1
        size = np.bincount(run)[run]
        fits = open_ & (size <= CROWD) & ~((size == n) & left & right)
        if d == depth:
            whole, crowded = hashes, ~fits
        edge = (left & (run == 0)) | (right & (run == run[-1]))
        key[fits], level[fits] = hashes[fits], np.where((size > 1) | edge, d, 0)[fits]
        open_ &= ~fits
        if not open_.any():
            break
    if open_.any():
        block = place - np.maximum.accumulate(np.where(first, place, 0))
        key[open_] = mix(hashes + (block // CROWD).astype(np.uint64) + np.uint64(place[0]))[open_]
        level[open_] = DEALT
    return key.view(np.int64), level, whole.view(np.int64), crowded


def regions(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, tree, key, depth) of every region, and (id, tree, key) of those crowded at ``whole_depth``.

    Each tree's order is sorted over all partitions; longest common prefixes of
    neighbours cut it into regions.
    """
    depth, kind = whole_depth(percent), nodes.schema["id"].dataType.simpleString()
    near = written(neighbours(nodes, percent), "neighbours")
    packed = near.groupBy("id").agg(F.collect_list("tree").alias("trees")).join(nodes, "id").select("id", "signature", "trees")

    def orders(batches):
        for batch in batches:
            row, tree, (ids, signatures) = taken_apart(batch)
            sigs = values_of(batch.column(1))
            order = sigs[row[:, None], (STEP * tree[:, None] + np.arange(DEEPEST)) % SIZE]
            yield pa.record_batch([pa.array(tree, pa.int32()), pa.array([x.tobytes() for x in order], pa.binary()), ids], names=["tree", "order", "id"])

    rows = packed.mapInArrow(orders, f"tree int, order binary, id {kind}")
    rows = rows.repartitionByRange(partitions(rows), "tree", "order", "id").sortWithinPartitions("tree", "order")

    def run(batches):
        for rows, left, right in by_run(batches, depth):
            key, level, whole, crowded = cut_regions(rows, depth, left, right)
            columns = [rows.column("id").combine_chunks(), rows.column("tree").combine_chunks(), key, level, whole, crowded]
            yield pa.record_batch([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["id", "tree", "key", "depth", "whole", "crowded"])

    cut = written(rows.mapInArrow(run, f"id {kind}, tree int, key long, depth tinyint, whole long, crowded boolean"), "regions")
    wide = written(cut.where("crowded").select("whole").distinct(), "crowded")
    return cut.where("depth > 0").select("id", "tree", "key", "depth"), cut.join(wide, "whole").select("id", "tree", F.col("whole").alias("key"))


def region_pairs(keys: np.ndarray, trees: np.ndarray, sigs: np.ndarray, depths: np.ndarray, sides: np.ndarray, parts: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs among rows sorted by key, as row numbers.

    Rows of one part are connected already; rows of one side are compared only if it is 0.
    """
    left, right = [], []
    step, live = 1, np.arange(len(keys))
    while len(live):
        live = live[live + step < len(keys)]
        live = live[keys[live] == keys[live + step]]
        for at in range(0, len(live), 2048):
            i = live[at : at + 2048]
            i = i[(parts[i] != parts[i + step]) & ((sides[i] == 0) | (sides[i] != sides[i + step]))]
            close = i[(sigs[i] == sigs[i + step]).sum(1) >= agree]
            if len(close):
                first = first_meeting(sigs[close], sigs[close + step], depths[close], depths[close + step], trees[close])
                left.append(close[first])
                right.append(close[first] + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return a, b


def first_meeting(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Whether no earlier tree has the two in one region."""
    apart = np.concatenate([x != y, x[:, :DEEPEST] != y[:, :DEEPEST]], axis=1)
    sums = np.concatenate([np.zeros((len(x), 1), np.int32), np.cumsum(apart, axis=1, dtype=np.int32)], axis=1)
    starts = np.arange(TREES) * STEP
    depth = np.where((dx == dy) & (dx > 0) & (dx < DEALT), dx, 0).astype(np.int64)
    met = (depth > 0) & (np.take_along_axis(sums, starts + depth, axis=1) == sums[:, starts])
    return ~(met & (np.arange(TREES) < tree[:, None])).any(1)


def by_key(batches, least: int = 4096):
    """Tables of whole groups from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        if keys[0] != keys[-1]:
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def least_agreement(percent: int) -> int:
    """Equal values of two signatures that may belong to a similar pair."""
    share = percent / 100
    return int(np.floor(SIZE * (share - 4.5 * np.sqrt(share * (1 - share) / SIZE))))


def columns_of(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, trees, signatures, depths, sides and numbered parts of region rows."""
    n = rows.num_rows
    sigs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u2").reshape(n, SIZE)
    depths = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("depths").chunks]).reshape(n, TREES)
    number = {}
    parts = np.array([number.setdefault(x, len(number)) for x in rows.column("part").to_pylist()], np.int64)
    return rows.column("key").to_numpy(), rows.column("tree").to_numpy(), sigs, depths, rows.column("side").to_numpy(), parts


def candidates(near: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The nodes that have candidates, with the regions that bring them together."""
    kind = nodes.schema["id"].dataType.simpleString()
    mine = near.groupBy("id").agg(F.collect_list(F.struct("tree", "key", "depth")).alias("regions")).join(nodes, "id").select("id", "signature", "regions")

    def run(batches):
        for batch in batches:
            row, regions, (ids, signatures) = taken_apart(batch)
            tree, key, depth = (regions.field(i) for i in range(3))
            depths = np.zeros((batch.num_rows, TREES), np.int8)
            depths[row, tree.to_numpy()] = depth.to_numpy()
            depths = pa.FixedSizeListArray.from_arrays(pa.array(depths[row].ravel()), TREES).cast(pa.list_(pa.int8()))
            yield pa.record_batch([key, tree, ids, signatures, depths, pa.array(np.zeros(len(row), np.int32)), ids], names=["key", "tree", "id", "signature", "depths", "side", "part"])

    return compared(mine.mapInArrow(run, f"key long, tree int, id {kind}, signature binary, depths array<tinyint>, side int, part {kind}"), percent)


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """(key, tree, id, depths, side, part): the rows that have candidates among those of their key."""
    agree, kind = least_agreement(percent), rows.schema["id"].dataType.simpleString()
    rows = rows.repartition(partitions(rows), "key").sortWithinPartitions("key")

    def run(batches):
        for rows in by_key(batches):
            a, b = region_pairs(*columns_of(rows), agree)
            found = rows.take(pa.array(np.unique(np.concatenate([a, b])))).select(["key", "tree", "id", "depths", "side", "part"]).combine_chunks()
            yield from found.to_batches()

    return rows.mapInArrow(run, f"key long, tree int, id {kind}, depths array<tinyint>, side int, part {kind}")


def crossed(wide: DataFrame, label: DataFrame, nodes: DataFrame, hubs: DataFrame | None, percent: int) -> DataFrame | None:
    """``compared`` nodes of the wide regions that the links so far leave in several parts.

    A region's nodes outside its largest part and those in it are dealt into
    blocks.  Every block of the first kind meets every block, or with ``hubs``
    (id, n) only the region's ``HUBS`` nodes of most links.  None if no region
    is in several parts.
    """
    parts = wide.join(label.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "tree", "key", F.coalesce("component", "id").alias("part"))
    parts = written(parts, "wide")
    sizes = parts.groupBy("key", "part").count().groupBy("key").agg(F.max(F.struct("count", "part")).alias("most"), F.sum("count").alias("all"))
    mixed = written(sizes.select("key", F.col("most.part").alias("main"), F.col("most.count").alias("most"), (F.col("all") - F.col("most.count")).alias("others")).where("others > 0"), "mixed")
    if mixed.isEmpty():
        return None
    block = max(1, CROWD // 2)
    placed = parts.join(mixed, "key").withColumn("_left", F.ceil(F.col("others") / block).cast("int")).withColumn("_right", F.ceil(F.col("most") / block).cast("int"))
    if hubs is not None:
        ranked = placed.join(hubs, "id").withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "id")))
        best = signed(ranked.where(F.col("_rank") <= HUBS).drop("n", "_rank"), nodes)
        placed = placed.where("part <> main")
    placed = signed(placed, nodes)
    own = "cast(pmod(xxhash64(id, tree, key), {}) as int)"
    outer = placed.where("part <> main").withColumn("_block", F.expr(own.format("_left")))
    if hubs is None:
        inner = placed.where("part = main").withColumn("_block", F.expr("_left + " + own.format("_right")))
        all_blocks, left = F.expr("sequence(0, _left + _right - 1)"), F.expr("sequence(0, _left - 1)")
        rows = outer.withColumn("_other", F.explode(all_blocks)).union(inner.withColumn("_other", F.explode(left)))
        rows = rows.withColumn("side", F.expr("if(_block = _other, 0, if(_block < _other, 1, 2))"))
        rows = rows.withColumn("_key", F.expr("xxhash64(key, least(_block, _other), greatest(_block, _other))"))
    else:
        rows = outer.withColumn("side", F.lit(1)).unionByName(best.withColumn("_block", F.explode(F.expr("sequence(0, _left - 1)"))).withColumn("side", F.lit(2)))
        rows = rows.withColumn("_key", F.expr("xxhash64(key, _block)"))
    # A pair that shares as long a prefix in an earlier tree has been compared there; hubs differ by tree.
    depth = 0 if hubs is not None else whole_depth(percent)
    rows = rows.select(F.col("_key").alias("key"), "tree", "id", "signature", F.expr(f"array_repeat({depth}Y, {TREES})").alias("depths"), "side", "part")
    return compared(rows, percent)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    joint = np.concatenate([x, y])
    joint.sort()
    same = int((joint[1:] == joint[:-1]).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def region_links(rows: pa.Table, percent: int) -> list[tuple]:
    """Links that connect the nodes of whole regions as all their similar pairs do."""
    sets = [np.frombuffer(m, np.uint64) for m in rows.column("members").to_pylist()]
    ids, links, columns = rows.column("id").to_pylist(), [], columns_of(rows)
    root = list(range(rows.num_rows))
    for i, first in enumerate(np.unique(columns[-1], return_index=True)[1][columns[-1]].tolist()):
        root[i] = first

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(*(x.tolist() for x in region_pairs(*columns, least_agreement(percent))), strict=True):
        x, y = find(a), find(b)
        if x != y and similar(sets[a], sets[b], percent):
            root[x] = y
            links.append((ids[a], ids[b]))
    return links


def confirmed(found: DataFrame, docs: DataFrame, id_column: str, gram: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what the pairs of similar full sets connect.

    The texts are dealt out by id, as the nodes with candidates may be a large
    part of all; a hint keeps it so for small inputs.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    each = found.groupBy("id").agg(F.first("depths").alias("depths"), F.collect_list(F.struct("key", "tree", "side", "part")).alias("regions"))
    texts = docs.select(F.col(id_column).alias("id"), "text").join(each.hint("shuffle_hash"), "id").select("id", "text", "depths", "regions")

    def members(batches):
        for part in slices(batches):
            ids, regions = part.column(0), part.column(3).to_pylist()
            sets = list(shingle_sets(part, 1, gram))
            row = np.repeat(np.arange(part.num_rows), [len(r) if len(x) else 0 for r, x in zip(regions, sets, strict=True)])
            own = [r for r, x in zip(regions, sets, strict=True) if len(x) for r in r]
            packed = [(x.tobytes(), signature(x)) if len(x) else (None, None) for x in sets]
            size = np.array([len(x) * 8 + 1024 for x in sets], np.int64)[row].cumsum()
            for at in np.split(np.arange(len(row)), np.searchsorted(size, np.arange(SENT, size[-1], SENT))) if len(row) else []:
                take, sent = pa.array(row[at]), [own[i] for i in at]
                out = [pa.array([r["key"] for r in sent], pa.int64()), pa.array([r["tree"] for r in sent], pa.int32()), ids.take(take), pa.array([packed[i][1] for i in row[at]], pa.binary()), part.column(2).take(take), pa.array([packed[i][0] for i in row[at]], pa.binary()), pa.array([r["side"] for r in sent], pa.int32()), pa.array([r["part"] for r in sent], ids.type)]
                yield pa.record_batch(out, names=["key", "tree", "id", "signature", "depths", "members", "side", "part"])

    schema = f"key long, tree int, id {kind}, signature binary, depths array<tinyint>, members binary, side int, part {kind}"
    rows = by_arrow(texts, members, schema).repartition(partitions(docs), "key").sortWithinPartitions("key")

    def compare(batches):
        for table in by_key(batches, 256):
            links, kind_of = region_links(table, percent), table.schema.field("id").type
            yield pa.record_batch([pa.array([x for x, _ in links], kind_of), pa.array([y for _, y in links], kind_of)], names=["a", "b"])

    return rows.mapInArrow(compare, f"a {kind}, b {kind}")


def linked(nodes: DataFrame, docs: DataFrame, id_column: str, gram: int, percent: int) -> DataFrame:
    """(node, component) of the nodes with links: from regions first, then what these leave apart in the wide ones."""
    near, wide = regions(nodes, percent)
    found = written(candidates(near, nodes, percent), "candidates")
    links = written(confirmed(found, docs, id_column, gram, percent), "links")
    label = components(links)
    if wide.isEmpty():
        return label
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    for hubs in (ends, None):
        met = crossed(wide, label, nodes, hubs, percent)
        if met is None:
            break
        more = confirmed(written(met, "candidates"), docs, id_column, gram, percent)
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return label


def classes(docs: DataFrame, id_column: str = "doc_id", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Per document: set size, the least id of its class, and whether it is that one."""
    facts = written(described(docs, id_column, gram), "signatures")
    nodes = facts.where("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.min("signature").alias("signature"), F.count("*").alias("n"))
    nodes = written(nodes, "nodes")
    label = linked(nodes.select("id", "signature"), docs, id_column, gram, percent)
    shared = nodes.where("n > 1").select("set_key", F.col("id").alias("node"))
    placed = facts.select("id", "n_shingles", "set_key").join(shared, "set_key", "left").withColumn("node", F.coalesce("node", "id"))
    return placed.join(label, "node", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "node").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component", "node")).alias("kept")
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are not their class's first; those without id stay."""
    gone = classes(docs, id_column, gram, percent).where("not kept").select(id_column)
    return docs.join(gone, id_column, "left_anti")
