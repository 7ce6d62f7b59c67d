"""Benchmark decontamination by winnowed word fingerprints.

Words are lower-cased (A-Z only) runs of characters other than ASCII
non-alphanumerics.  A window is ``window`` consecutive words of an item; an item
with fewer words, but not none, is one window of all its words.  Both sides are
winnowed: of the k-gram hashes in every stretch of ``window`` words the smallest
is kept, so a shared window always shares a kept fingerprint.  Fingerprints are
joined and each hit is extended to whole windows, which are compared by their
word hashes.  Items shorter than a window have one fingerprint over all their
words, looked up at every document position (one pass per such length).

The benchmark side is sent to every task only while its fingerprints stay under
``broadcast_limit``; beyond it the fingerprints, and then the windows around
those that both sides have, are joined by a shuffle.

Nulls: a null text has no words and is clean; a null item never occurs.  Empty
tables give empty or clean results.  Repeated items with one id count once;
repeated documents each get their row, and rows that repeat an id with other
texts are judged each by its own.  Ties between least hashes go to the leftmost
one, which both sides do alike.  Very long texts are taken whole, one at a time.
Extra columns are ignored unless ``keep`` names them; ``clean_documents`` keeps
columns of any name, those of the result included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import apart, by_arrow, written
from .kernels import Words, byte_table, covered, gram_spans, grams, keyed, mix, place_of, slices, sliding_min, text_view

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WINDOW, GRAM = 10, 4
BROADCAST_LIMIT = 500_000
TABLE = byte_table(separators=SEPARATORS, lower=True)
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words array<int>"


def winnow(gram_hash: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the (leftmost) least hash of a stretch of ``width`` grams."""
    if len(gram_hash) < width:
        return np.zeros(0, np.int64)
    return np.unique(place_of(sliding_min(keyed(gram_hash), width)))


class Index:
    """The windows of benchmark items, by fingerprint."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        ids, texts = [i for i, _ in items], pa.array([t for _, t in items], pa.large_string())
        w = Words(*text_view(texts), TABLE)
        self.ids = ids
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        full_hash, full_item, prints = [], [], []
        whole = grams(w.hash, window)
        gram_hash = grams(w.hash, gram)
        short: dict[int, list[tuple[int, int]]] = {}
        for i, (first, n) in enumerate(zip(w.first.tolist(), w.count.tolist(), strict=True)):
            if n >= window:
                full_hash.append(whole[first : first + n - window + 1])
                full_item.append(np.full(n - window + 1, i))
                own = gram_hash[first : first + n - gram + 1]
                prints.append(own[winnow(own, window - gram + 1)])
            elif n:
                short.setdefault(n, []).append((int(grams(w.hash[first : first + n], n)[0]), i))
        none = np.zeros(0, np.uint64)
        self.prints = np.unique(np.concatenate(prints)) if prints else none
        self.windows = self._sorted(np.concatenate(full_hash) if full_hash else none, np.concatenate(full_item) if full_item else np.zeros(0, np.int64))
        for n, found in short.items():
            self.short[n] = self._sorted(np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found]))

    @staticmethod
    def _sorted(hashes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((items, hashes))
        return hashes[order], items[order]

    @staticmethod
    def within(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(sorted_hashes):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(sorted_hashes, hashes)
        at[at == len(sorted_hashes)] = 0
        return sorted_hashes[at] == hashes

    def hits(self, w: Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Hit words of a slice, and (document, item) pairs of the windows found."""
        n, window, gram = len(w.hash), self.window, self.gram
        starts, ends, pairs = [], [], []
        doc_of = w.doc()
        if len(self.prints) and n >= window:
            gram_hash = grams(w.hash, gram)
            kept = winnow(gram_hash, window - gram + 1)
            kept = kept[self.within(self.prints, gram_hash[kept])]
            if len(kept):
                whole = grams(w.hash, window)
                at = np.unique((kept[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
                at = at[(at >= 0) & (at < len(whole))]
                at = at[doc_of[at] == doc_of[at + window - 1]]
                at = at[self.within(self.windows[0], whole[at])]
                starts.append(at)
                ends.append(at + window)
                pairs.append(self._items(self.windows, whole[at], doc_of[at]))
        for length, found in self.short.items():
            at, doc = gram_spans(w.first, w.count, length)
            hashes = grams(w.hash, length)[at]
            ok = self.within(found[0], hashes)
            starts.append(at[ok])
            ends.append(at[ok] + length)
            pairs.append(self._items(found, hashes[ok], doc[ok]))
        if not starts:
            return np.zeros(n, bool), pairs
        return covered(np.concatenate(starts), np.concatenate(ends), n), pairs

    @staticmethod
    def _items(found: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.searchsorted(found[0], hashes)
        each = np.searchsorted(found[0], hashes, side="right") - left
        skip = np.repeat(np.cumsum(each) - each, each)
        return np.repeat(docs, each), found[1][np.repeat(left, each) + np.arange(int(each.sum())) - skip]

    def judge(self, batch: pa.RecordBatch, text: int, keep: list[int]) -> pa.RecordBatch:
        w = Words(*text_view(batch.column(text)), TABLE)
        hit, pairs = self.hits(w)
        items: list[list[str]] = [[] for _ in range(batch.num_rows)]
        if any(len(d) for d, _ in pairs):
            both = np.unique(np.stack([np.concatenate([d for d, _ in pairs]), np.concatenate([i for _, i in pairs])]), axis=1)
            for d, i in both.T.tolist():
                items[d].append(self.ids[i])
        return _result(batch, keep, w, hit, [sorted(set(x)) for x in items])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", window: int = WINDOW, gram: int = GRAM, broadcast_limit: int = BROADCAST_LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: words, hit words, items found, their digest and whether any word is hit.

    ``broadcast_limit`` bounds the benchmark words whose windows are sent to all
    tasks (about 20 bytes each); a larger benchmark takes the shuffled way.
    ``hit_words`` are the positions of hit words.  ``keep`` names further columns
    to carry along.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = list(dict.fromkeys([id_column, *keep]))
    columns = list(dict.fromkeys([*wanted, "text"]))
    kept, text = [columns.index(c) for c in wanted], columns.index("text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in wanted) + ", " + RESULT
    if size <= 4 * broadcast_limit:
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.orderBy("item", "text").collect()], window, gram))

        def run(batches):
            for part in slices(batches, "text"):
                yield index.value.judge(part, text, kept)

        return by_arrow(docs.select(*columns), run, schema)
    return _shuffled(docs, items, id_column, window, gram, columns, kept, text, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that hold no window, with all their columns whatever their names."""
    inner, columns = apart(docs, id_column, "text")
    return decontaminate(inner, benchmark, id_column, keep=tuple(inner.columns), **how).where(~F.col("contaminated")).select(*columns)


def _item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, length, hash): every window of every item, and its winnowed fingerprints with length 0."""

    def run(batches):
        for part in slices(batches):
            w = Words(*text_view(part.column(1)), TABLE)
            found = []
            for n in range(1, window):
                rows = np.flatnonzero(w.count == n)
                found.append((rows, n, grams(w.hash, n)[w.first[rows]]))
            at, doc = gram_spans(w.first, w.count, window)
            found.append((doc, window, grams(w.hash, window)[at]))
            at, doc, prints = _winnowed(w, window, gram)
            found.append((doc, 0, prints))
            rows, lengths, hashes = (np.concatenate(x) for x in zip(*((r, np.full(len(r), n, np.int32), h) for r, n, h in found), strict=True))
            yield pa.record_batch([part.column(0).take(pa.array(rows)), pa.array(lengths), pa.array(hashes.view(np.int64))], names=["item", "length", "hash"])

    return by_arrow(items.select("item", "text"), run, "item string, length int, hash long")


def _winnowed(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, documents and hashes of the kept fingerprints that lie inside one document."""
    doc_of, gram_hash = w.doc(), grams(w.hash, gram)
    kept = winnow(gram_hash, window - gram + 1)
    kept = kept[doc_of[kept] == doc_of[kept + gram - 1]]
    return kept, doc_of[kept], gram_hash[kept]


def _shuffled(docs, items, id_column, window, gram, columns, kept, text, schema):
    """The way for benchmarks of any size: fingerprints, then windows, are joined by a shuffle.

    A row is known by a hash of id and text.  Its fingerprints are held against
    the benchmark's by a semi-join, which repeats nothing however common a
    fingerprint is; only windows around those that remain are sent on, and a
    joined window is a hit, never a mere candidate.  Short items add the lengths
    that they have, and no others.
    """
    facts = written(_item_windows(items, window, gram), "benchmark")
    windows, prints = facts.where("length > 0").distinct(), facts.where("length = 0").select("hash").distinct()
    short = sorted(r[0] for r in windows.where(F.col("length") < window).select("length").distinct().collect())
    key = F.xxhash64(F.col(id_column), F.col("text"))
    source = docs.where("text is not null").select(key.alias("row"), "text")

    def look(batches):
        for part in slices(batches):
            _, doc, hashes = _winnowed(Words(*text_view(part.column(1)), TABLE), window, gram)
            yield pa.record_batch([part.column(0).take(pa.array(doc)), pa.array(hashes.view(np.int64))], names=["row", "hash"])

    matched = by_arrow(source, look, "row long, hash long").join(prints, "hash", "left_semi").groupBy("row").agg(F.collect_set("hash").alias("hashes"))

    def extend(batches):
        for part in slices(batches):
            w = Words(*text_view(part.column(1)), TABLE)
            at, doc, hashes = _winnowed(w, window, gram)
            held = part.column(2).to_pylist()
            own = np.concatenate([np.array(x or [], np.int64) for x in held]).view(np.uint64)
            of = np.repeat(np.arange(len(held)), [len(x or []) for x in held])
            at = at[np.isin(mix(hashes + mix(doc.astype(np.uint64))), mix(own + mix(of.astype(np.uint64))))]
            starts, lengths, rows, found = [], [], [], []
            spots, docs_at = gram_spans(w.first, w.count, window)
            near = np.unique((at[:, None] - np.arange(window - gram + 1)).ravel())
            close = np.isin(spots, near)
            for n, spot, row in [(window, spots[close], docs_at[close]), *((n, *gram_spans(w.first, w.count, n)) for n in short)]:
                starts.append(spot - w.first[row])
                lengths.append(np.full(len(spot), n, np.int32))
                rows.append(row)
                found.append(grams(w.hash, n)[spot])
            starts, lengths, rows, found = (np.concatenate(x) for x in (starts, lengths, rows, found))
            yield pa.record_batch([part.column(0).take(pa.array(rows)), pa.array(found.view(np.int64)), pa.array(starts.astype(np.int32)), pa.array(lengths)], names=["row", "hash", "start", "length"])

    near = source.join(matched, "row", "left" if short else "inner").select("row", "text", "hashes")
    hits = by_arrow(near, extend, "row long, hash long, start int, length int").join(windows, ["hash", "length"])
    hits = hits.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("_hits"), F.collect_set("item").alias("_items"))
    joined = docs.select(*columns, key.alias("_row")).join(hits, F.col("_row") == F.col("row"), "left").select(*columns, "_hits", "_items")

    def run(batches):
        for part in slices(batches, "text"):
            w = Words(*text_view(part.column(text)), TABLE)
            spans, items_of = part.column(len(columns)).to_pylist(), [sorted(x or []) for x in part.column(len(columns) + 1).to_pylist()]
            row = np.repeat(np.arange(len(spans)), [len(x or []) for x in spans])
            start = w.first[row] + np.array([x["start"] for s in spans for x in s or []], np.int64)
            hit = covered(start, start + np.array([x["length"] for s in spans for x in s or []], np.int64), len(w.hash))
            yield _result(part, kept, w, hit, items_of)

    return by_arrow(joined, run, schema)


def _result(batch: pa.RecordBatch, keep: list[int], w: Words, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    """The kept columns and what ``hit`` words and found ``items`` (sorted, distinct) say of each row."""
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[w.first + w.count] - sums[w.first]
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    where = [np.flatnonzero(hit[f : f + c]).tolist() if h else [] for f, c, h in zip(w.first.tolist(), w.count.tolist(), n_hit.tolist(), strict=True)]
    return pa.record_batch(
        [batch.column(c) for c in keep]
        + [pa.array(w.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0), pa.array(where, pa.list_(pa.int32()))],
        names=[batch.schema.names[c] for c in keep] + ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_words"],
    )
