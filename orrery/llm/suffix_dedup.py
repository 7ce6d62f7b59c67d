"""Exact substring dedup by hash-compared suffix sorting.

A byte goes if it is covered by a ``LENGTH``-byte string that also begins in a
document with a smaller id.  Sorting every suffix of a corpus in one order is
not needed for that: strings of ``LENGTH`` bytes can only be equal if they hold
the same *anchor*, the ``GRAM``-byte gram of least hash among those inside, at
the same offset.  So the strings are dealt out by anchor:

1. Each document is cut into stretches of strings with one anchor.  Anchor hash
   and place are exchanged; anchors that only one document has are done with.
2. The bytes of the other stretches are exchanged.  Equal stretches, found by
   hash and compared byte by byte, leave the least document's.  Where an
   anchor's stretches differ, their suffixes are sorted, per anchor and offset,
   by a mergesort that compares two suffixes through prefix polynomial hashes: a
   binary search finds their common extension, the byte after it decides.
   Neighbours in that order with a common extension of ``LENGTH`` are compared
   byte by byte; the least document of each run of equals keeps the string.

So a hash collision cannot remove anything.  A task resolves what it can among
the documents of a chunk, by the same comparison of bytes, before anything is
sent, so a passage that fills the corpus crosses once per chunk.  An anchor with
more than ``HOT`` stretches is dealt out string by string, by offset and all of
a string's bytes, as strings that differ there cannot be equal.

Nulls: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows
with a null id neither lose bytes nor take them from others.  Rows that repeat
an id are one document, each with its own bytes and spans: they never take bytes
from each other.  That also settles ties.  An empty table gives no rows, and
very long texts are cut whole, one at a time.  Extra columns are ignored.  Ids
must be integers; another type is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_arrow, written
from .exchange import CHUNK_BYTES, bucket_keys, exchanged, integer_ids, numbers, packets, per_document, received, row_tags, schema, spread
from .kernels import BASE_INVERSE, BYTE_CODES, covered, keyed, mix, place_of, powers, prefix_sums, slices, sliding_min, span_hashes, text_view

LENGTH, GRAM = 50, 18
WIDTH = LENGTH - GRAM + 1
SORTED_AT_ONCE, HOT = 12_000, 4096


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a slice of texts: row, anchor, first and last string start of each stretch, anchor hash and stretch hash."""
    n = len(data)
    rooms = np.maximum(np.diff(at) - LENGTH + 1, 0)
    starts = spread(at[:-1], rooms)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(BYTE_CODES[data])
    every = np.arange(n - GRAM + 1)
    gram_hash = span_hashes(sums, every, every + GRAM)
    anchor = place_of(sliding_min(keyed(gram_hash), WIDTH))[starts]
    row = np.repeat(np.arange(len(rooms)), rooms)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(anchor)) - 1
    row, anchor, low, high = row[first], anchor[first], starts[first], starts[last]
    return row, anchor, low, high, gram_hash[anchor], stretch_hash(sums, low, high - low, anchor - low)


def stretch_hash(sums: np.ndarray, begin: np.ndarray, more: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Of the bytes of stretches and the places of their anchors."""
    return mix(span_hashes(sums, begin, begin + more + LENGTH) + back.astype(np.uint64))


def string_keys(sums: np.ndarray, anchor: np.ndarray, begin: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Where single strings of a hot anchor go: by anchor, its place and all their bytes, so only equal strings crowd."""
    return mix(anchor ^ mix(span_hashes(sums, begin, begin + LENGTH) + back.astype(np.uint64)))


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes at x and y agree over the given lengths."""
    out = np.zeros(len(x), bool)
    offsets = np.arange(LENGTH + WIDTH)
    for at in range(0, len(x), 1 << 15):
        i = slice(at, at + (1 << 15))
        inside = offsets < length[i, None]
        offset = np.where(inside, offsets, 0)
        out[i] = (data[x[i, None] + offset] == data[y[i, None] + offset]).all(1)
    return out


def resolved(anchor: np.ndarray, stretch: np.ndarray, more: np.ndarray, ids: np.ndarray, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries a smaller document's equal bytes cover whole; which of the others share their anchor with a different stretch of another document."""
    n = len(ids)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((ids, stretch, anchor))
    a, s, d = anchor[order], stretch[order], ids[order]
    new_anchor = np.concatenate(([True], a[1:] != a[:-1]))
    new_class = new_anchor | np.concatenate(([True], s[1:] != s[:-1]))
    starts = np.flatnonzero(new_anchor)
    group = np.cumsum(new_anchor) - 1
    first = np.maximum.accumulate(np.where(new_class, np.arange(n), 0))
    later = np.flatnonzero(d > d[first])
    own, other = order[later], order[first[later]]
    equal = (more[own] == more[other]) & same_bytes(data, begin[own], begin[other], more[own] + LENGTH)
    whole = np.zeros(n, bool)
    whole[later] = equal
    differ = new_class.astype(np.int64)
    differ[later[~equal]] = 1
    mixed = (np.add.reduceat(differ, starts) > 1) & (np.maximum.reduceat(d, starts) > np.minimum.reduceat(d, starts))
    out, open_ = np.zeros(n, bool), np.zeros(n, bool)
    out[order] = whole
    open_[order] = ~whole & mixed[group]
    return out, open_


def merged(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each row (id and tag) united where they touch."""
    if not len(ids):
        return ids, tags, start, end
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = ids[order], tags[order], start[order], end[order]
    # one running maximum over all rows: each row's places are lifted above those before it
    lift = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    begins = np.flatnonzero(np.concatenate(([True], start[1:] + lift[1:] > reach[:-1])))
    stops = np.append(begins[1:], len(ids)) - 1
    return ids[begins], tags[begins], start[begins], reach[stops] - lift[stops]


class SuffixSort:
    """Mergesort of suffixes inside groups, compared through prefix polynomial hashes up to ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        self.sums = prefix_sums(BYTE_CODES[data])
        self.inverse = powers(len(data) + 1, BASE_INVERSE)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at x and y have in common, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.depth)
        sx, sy, ix, iy = self.sums[x], self.sums[y], self.inverse[x], self.inverse[y]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = (self.sums[x + middle] - sx) * ix == (self.sums[y + middle] - sy) * iy
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """suffix x < suffix y, or <= where ``or_equal``."""
        common = self.common(x, y)
        same = common >= self.depth
        ahead = np.minimum(common, self.depth - 1)
        return np.where(same, or_equal, self.data[x + ahead] < self.data[y + ahead])

    def order(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """An order of ``starts`` by group, then suffix; equal suffixes keep their order.  ``group`` is sorted."""
        n = len(starts)
        perm = np.arange(n)
        if not n:
            return perm
        base = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(base, n))
        base, stop = np.repeat(base, size), np.repeat(base + size, size)
        run, live = 1, np.flatnonzero(np.repeat(size, size) > 1)
        while len(live):
            index = live - base[live]
            block = base[live] + index // (2 * run) * (2 * run)
            left = index % (2 * run) < run
            other = np.where(left, block + run, block)
            low = np.minimum(other, stop[live])
            high = np.minimum(other + run, stop[live])
            first, own = low.copy(), starts[perm[live]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                # a partner goes before if it is less, or equal and from the left run
                before = self.less(starts[perm[middle]], own[open_], ~left[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = block + np.where(left, index % (2 * run), index % (2 * run) - run) + (low - first)
            moved = perm[live]
            perm[place] = moved
            run *= 2
            live = live[(stop - base)[live] > run]
        return perm

    def equal_runs(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of starts in their order: a number for each run of equal, byte by byte verified strings."""
        if not len(starts):
            return np.zeros(0, np.int64)
        near = np.flatnonzero(group[1:] == group[:-1])
        near = near[self.common(starts[near], starts[near + 1]) >= self.depth]
        same = np.zeros(len(starts), bool)
        offsets = np.arange(self.depth)
        for at in range(0, len(near), 1 << 16):
            i = near[at : at + (1 << 16)]
            same[i + 1] = (self.data[starts[i][:, None] + offsets] == self.data[starts[i + 1][:, None] + offsets]).all(1)
        return np.cumsum(~same)


def covered_strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray, back: np.ndarray, anchor: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and offset of the strings that a smaller document also has.

    Entry i holds ``size[i]`` string starts from ``begin[i]`` on in ``data``; its
    anchor lies ``back[i]`` bytes after the first.
    """
    entry = np.repeat(np.arange(len(ids)), size)
    offset = spread(np.zeros(len(ids), np.int64), size)
    key = mix(anchor[entry] + mix((back[entry] - offset).astype(np.uint64)))
    order = np.lexsort((ids[entry], key))
    k, d = key[order], ids[entry[order]]
    begins = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    heads = np.flatnonzero(begins)
    size_of = np.diff(np.append(heads, len(k)))
    several = np.repeat(d[heads] < d[heads + size_of - 1], size_of) if len(k) else begins
    order, k = order[several], k[several]
    entry, offset = entry[order], offset[order]
    sorter = SuffixSort(data, LENGTH)
    starts = begin[entry] + offset
    perm = sorter.order(starts, k)
    entry, offset, k = entry[perm], offset[perm], k[perm]
    run = sorter.equal_runs(begin[entry] + offset, k)
    if not len(run):
        return entry, offset
    d = ids[entry]
    heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    least = np.repeat(np.minimum.reduceat(d, heads), np.diff(np.append(heads, len(d))))
    gone = d > least
    return entry[gone], offset[gone]


def chunked(batches):
    """Ids, tags, stretches and bytes of (id, tag, text) rows, in chunks of about ``CHUNK_BYTES``."""
    held, size = [], 0
    for part in slices(batches):
        data, at = text_view(part.column(2))
        row, anchor, low, high, anchor_hash, stretch = stretches(data, at)
        ids, tags = np.asarray(part.column(0)), np.asarray(part.column(1)).view(np.uint64)
        held.append([ids[row], tags[row], anchor_hash, stretch, low - at[:-1][row], high - low, anchor - low, low + size, data])
        size += len(data)
        if size >= CHUNK_BYTES:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


OPEN = {"low": 4, "more": 1, "back": 1, "hot": 1}
SPANS = {"start": 4, "end": 4}


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(id, tag, low, more, back, hot, start, end): stretches whose anchor other documents have, and spans that a chunk has resolved."""
    homes = bucket_keys(texts)
    buckets = len(homes)

    def send(batches):
        for ids, tags, anchor, stretch, low, more, back, begin, data in chunked(batches):
            whole, _ = resolved(anchor, stretch, more, ids, data, begin)
            known, tag, start, end = merged(ids[whole], tags[whole], low[whole], low[whole] + more[whole] + LENGTH)
            none = np.zeros(len(known), np.int64)
            yield packets(homes[known % buckets], known, [(none, 0), (tag, 8), (start, 4), (end, 4), (none, 0)], part=1)
            rest = ~whole
            columns = [(anchor[rest], 8), (tags[rest], 8), (low[rest], 4), (more[rest], 1), (back[rest], 1)]
            yield packets(homes[(anchor[rest] % np.uint64(buckets)).astype(np.int64)], ids[rest], columns)

    def receive(batches):
        got = received(batches, {0: (8, 8, 4, 1, 1), 1: (0, 8, 4, 4, 0)})
        known, tags, start, end = merged(got[1][0], got[1][2], got[1][3].astype(np.int64), got[1][4].astype(np.int64))
        yield packets(homes[known % buckets], known, [(tags, 8), (start, 4), (end, 4), (np.zeros(len(known), np.int64), 0), (np.zeros(len(known), np.int64), 0)], part=1)
        ids, anchor, tags, low, more, back = got[0]
        order = np.lexsort((ids, anchor))
        a, d = anchor[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(a)))
        several = d[first] < d[first + size - 1] if len(first) else np.zeros(0, bool)
        own = order[np.repeat(several, size)]
        hot = np.repeat(size > HOT, size)[np.repeat(several, size)]
        yield packets(homes[ids[own] % buckets], ids[own], [(tags[own], 8), (low[own], 4), (more[own], 1), (back[own], 1), (hot, 1)])

    return per_document(exchanged(texts, send, 5, receive, schema(5)), {0: OPEN, 1: SPANS | {"": 0, " ": 0}})


def sorted_stretches(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """(id, tag, more_start, more_end): what equal stretches and the suffix sort of the others cover."""
    homes = bucket_keys(texts)
    buckets = len(homes)
    open_ = open_.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), *OPEN)
    joined = texts.join(open_, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("id", "tag", "text", *OPEN)

    def send(batches):
        for part in slices(batches):
            data, at = text_view(part.column(2))
            cells = [[numbers(x) for x in part.column(c).to_pylist()] for c in range(3, 7)]
            row = np.repeat(np.arange(part.num_rows), [len(x) for x in cells[0]])
            low, more, back, hot = (np.concatenate(x) for x in cells)
            # one entry for each string of a hot anchor's stretches
            each = np.where(hot == 1, more + 1, 1)
            step = spread(np.zeros(len(each), np.int64), each)
            row, low, more, back, hot = (np.repeat(x, each) for x in (row, low, more, back, hot == 1))
            low, back, more = low + step, back - step, np.where(hot, 0, more)
            begin = at[:-1][row] + low
            if not len(row):
                continue
            sums = prefix_sums(BYTE_CODES[data])
            anchor = span_hashes(sums, begin + back, begin + back + GRAM)
            anchor = np.where(hot, string_keys(sums, anchor, begin, back), anchor)
            ids, tags = np.asarray(part.column(0))[row], np.asarray(part.column(1)).view(np.uint64)[row]
            yield packets(homes[(anchor % np.uint64(buckets)).astype(np.int64)], ids, [(anchor, 8), (tags, 8), (low, 4), (more, 1), (back, 1)], blobs=(data, begin, more + LENGTH))

    def receive(batches):
        ids, anchor, tags, low, more, back, data = received(batches, {0: (8, 8, 4, 1, 1)}, blob=True)[0]
        low, more, back = low.astype(np.int64), more.astype(np.int64), back.astype(np.int64)
        length = more + LENGTH
        begin = np.cumsum(length) - length
        # anchors in slices of bounded size: all entries of an anchor are together
        order = np.argsort(anchor, kind="stable")
        heads = np.append(np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))), len(order)) if len(order) else np.zeros(1, np.int64)
        found = []
        at = 0
        while at < len(heads) - 1:
            stop = max(at + 1, int(np.searchsorted(heads, heads[at] + SORTED_AT_ONCE, side="right")) - 1)
            own = order[heads[at] : heads[stop]]
            local, base = data[spread(begin[own], length[own])], np.cumsum(length[own]) - length[own]
            stretch = stretch_hash(prefix_sums(BYTE_CODES[local]), base, more[own], back[own])
            whole, open_ = resolved(anchor[own], stretch, more[own], ids[own], local, base)
            w, o = own[whole], own[open_]
            entry, offset = covered_strings(local, base[open_], more[o] + 1, back[o], anchor[o], ids[o])
            start = low[o[entry]] + offset
            found.append(merged(*(np.concatenate(x) for x in ((ids[w], ids[o[entry]]), (tags[w], tags[o[entry]]), (low[w], start), (low[w] + length[w], start + LENGTH)))))
            at = stop
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        ids, tags, start, end = merged(*parts)
        yield packets(homes[ids % buckets], ids, [(tags, 8), (start, 4), (end, 4)])

    return per_document(exchanged(joined, send, 5, receive, schema(3), blob=True), {0: {"more_start": 4, "more_end": 4}})


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: bool = False) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, digest of the rest (and, if asked for, its bytes)."""
    source = docs.select(integer_ids(docs, id_column).alias("id"), row_tags(docs, id_column).alias("tag"), "text")
    texts = source.where("id is not null")
    first = written(shared_anchors(texts), "stretches")
    more = sorted_stretches(texts, first.where("length(low) > 0"))
    spans = first.select("id", "tag", *SPANS).join(more, ["id", "tag"], "left").withColumnsRenamed({"id": "_id", "tag": "_tag"})
    cells = ("start", "end", "more_start", "more_end")
    joined = texts.join(spans, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("id", "text", *cells)
    rows = joined.union(source.where("id is null").select("id", "text", *(F.lit(None).cast("binary").alias(c) for c in cells)))
    result = f"`{id_column}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text

    def run(batches):
        for part in slices(batches):
            data, at = text_view(part.column(1))
            starts, ends = ([numbers(x) for x in part.column(c).to_pylist()] for c in (2, 3))
            starts, ends = ([np.concatenate((x, numbers(y))) for x, y in zip(have, part.column(c).to_pylist(), strict=True)] for have, c in ((starts, 4), (ends, 5)))
            removed, runs, digests, kept = [], [], [], []
            for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = data[a:b]
                if len(starts[r]):
                    gone = covered(starts[r], ends[r], b - a)
                    own = own[~gone]
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                else:
                    runs.append(0)
                removed.append(b - a - len(own))
                digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                if text:
                    kept.append(own.tobytes())
            columns = [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch([*columns, *[pa.array(kept, pa.binary())] * text], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * text])

    return by_arrow(rows, run, result)
