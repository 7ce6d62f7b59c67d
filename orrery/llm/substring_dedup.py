"""Substring dedup by sliding spans of sentences.

A sentence ends after a word that closes with . ! or ?, at a newline, and at the
text's end.  A sentence of more than ``LONG`` words is cut further where its
content says so: at the least two-word hash of every ``CUT`` consecutive ones.
So no unit has more than ``LONG`` words, and the units of a passage are the same
in every document, but for a few words at its ends.  A span is the shortest run
of at least ``RUN`` units and ``LEAST`` words that begins, or that ends, with a
given unit; a text without such a run is one span.  Spans are hashed, joined over the whole corpus, and the
units covered by any span that is not its hash's first one (least document,
then place) are removed, with the white space after them.  A passage of 50 words
or more that two documents share always contains a span.

Nulls: a null text has no units and stays null; rows with a null id take no part
and stay whole.  Rows that repeat an id and text are one occurrence; rows that
repeat an id with another text are separate ones, in the order of a hash of the
text, which also settles ties.  Empty texts have no units, an empty table gives
no rows, and very long texts are cut whole, one at a time.  Extra columns are
ignored unless ``keep`` names them (not by the names of the result).  Ids must be
integers; another type is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_arrow
from .exchange import bucket_keys, chunks, exchanged, integer_ids, numbers, packets, per_document, received, row_tags, schema
from .kernels import Words, byte_table, covered, gram_spans, grams, keyed, place_of, prefix_sums, slices, sliding_min, span_hashes, text_view

SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
TABLE = byte_table(separators=SPACES)
RUN, LEAST, LONG, CUT = 3, 16, 8, 6
STEP_BITS, STEP_MASK = 5, 31  # a span is its first unit and how many follow; these are fewer than LEAST
CLOSES = np.isin(np.arange(256), list(b".!?"))


def own_cuts(w: Words) -> np.ndarray:
    """Words that hold the least two-word hash of ``CUT`` in a row, all inside one document."""
    least = sliding_min(keyed(grams(w.hash, 2)), CUT) if len(w.hash) > CUT else np.zeros(0, np.uint64)
    stretch, _ = gram_spans(w.first, w.count, CUT + 1)
    return np.unique(place_of(least[stretch]))


class Units:
    """Sentence units of a slice and the spans that begin at them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        w = Words(data, at, TABLE, nul=True)
        n = len(w.hash)
        begins = np.zeros(n + 1, bool)
        begins[w.first] = True
        begins[n] = True
        if n > 1:
            lines = np.concatenate(([0], np.cumsum(data == 10)))
            begins[1:n] |= CLOSES[data[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]])
        sentence = np.flatnonzero(begins)
        length = np.diff(sentence)
        long = np.repeat(length > LONG, length)
        cuts = own_cuts(w)
        begins[cuts[long[cuts]]] = True
        self.begin = np.flatnonzero(begins[:n])
        self.end = np.append(self.begin[1:], n)[: len(self.begin)]
        self.first = np.searchsorted(self.begin, w.first)
        self.count = np.diff(np.append(self.first, len(self.begin)))
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)
        self.place = np.arange(len(self.begin)) - self.first[self.doc]
        self.words, self.at = w, at
        every = np.arange(len(self.begin))
        low, limit = self.first[self.doc], (self.first + self.count)[self.doc]
        last = np.maximum(every + RUN - 1, np.searchsorted(self.end, self.begin + LEAST))
        back = np.minimum(every - RUN + 1, np.searchsorted(self.begin, self.end - LEAST, side="right") - 1)
        ahead, behind, whole = last < limit, back >= low, (self.place == 0) & (last >= limit)
        both = np.unique(np.concatenate([every[ahead] << STEP_BITS | (last - every)[ahead], back[behind] << STEP_BITS | (every - back)[behind], every[whole] << STEP_BITS | (limit - 1 - every)[whole]]))
        self.span_begin, self.span_last = both >> STEP_BITS, (both >> STEP_BITS) + (both & STEP_MASK)
        sums = prefix_sums(w.hash)
        self.hash = span_hashes(sums, self.begin[self.span_begin], self.end[self.span_last])
        self.span_doc = self.doc[self.span_begin]
        self.span_place = self.place[self.span_begin] << STEP_BITS | (both & STEP_MASK)

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """Each unit's bytes, up to the next unit or the text's end."""
        start = self.words.start[self.begin] if len(self.begin) else np.zeros(0, np.int64)
        stop = np.append(start[1:], 0)[: len(start)]
        final = np.zeros(len(start), bool)
        final[(self.first + self.count - 1)[self.count > 0]] = True
        stop[final] = self.at[1:][self.doc[final]]
        return start, stop


def later(hashes: np.ndarray, docs: np.ndarray, tags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Entries after their hash's first (document, text, place)."""
    order = np.lexsort((places, tags, docs, hashes))
    h, d, t, p = hashes[order], docs[order], tags[order], places[order]
    begins = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))
    out = np.zeros(len(h), bool)
    out[order] = (d != d[first]) | (t != t[first]) | (p != p[first])
    return out


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, tag, places) from (id, tag, text): the spans that are not their hash's first, as first unit and number of further ones."""
    homes = bucket_keys(texts)
    buckets = len(homes)

    def look(part):
        units = Units(*text_view(part.column(2)))
        ids, tags = np.asarray(part.column(0)), np.asarray(part.column(1)).view(np.uint64)
        return [units.hash, ids[units.span_doc], tags[units.span_doc], units.span_place]

    def send(batches):
        for hashes, ids, tags, places in chunks(batches, look):
            known = later(hashes, ids, tags, places)
            none = np.zeros(int(known.sum()), np.uint64)
            yield packets(homes[(ids[known] % buckets).astype(np.int64)], ids[known], [(none, 1), (tags[known], 8), (places[known], 4)], part=1)
            hashes, ids, tags, places = hashes[~known], ids[~known], tags[~known], places[~known]
            yield packets(homes[(hashes % np.uint64(buckets)).astype(np.int64)], ids, [(hashes, 8), (tags, 8), (places, 4)])

    def receive(batches):
        got = received(batches, {0: (8, 8, 4), 1: (1, 8, 4)})
        ids, hashes, tags, places = got[0]
        found = later(hashes, ids, tags, places.astype(np.int64))
        ids, tags, places = (np.concatenate(x) for x in ((ids[found], got[1][0]), (tags[found], got[1][2]), (places[found], got[1][3])))
        yield packets(homes[ids % buckets], ids, [(tags, 8), (places, 4)])

    return per_document(exchanged(texts, send, 3, receive, schema(2)), {0: {"places": 4}})


def deduplicated(docs: DataFrame, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: units, removed units and words, the text that is left and its digest."""
    wanted = list(dict.fromkeys([id_column, *keep]))
    columns = list(dict.fromkeys([*wanted, "text"]))
    text, tag = columns.index("text"), row_tags(docs, id_column)
    spans = repeated_spans(docs.where(F.col(id_column).isNotNull()).select(integer_ids(docs, id_column).alias("id"), tag.alias("tag"), "text"))
    spans = spans.select(F.col("id").alias("_id"), F.col("tag").alias("_other"), F.col("places").alias("_places"))
    joined = docs.select(*columns, tag.alias("_tag")).join(spans, (F.col(id_column) == F.col("_id")) & (F.col("_tag") == F.col("_other")), "left").select(*columns, "_places")
    counts = ("n_sentences", "n_removed", "n_words", "n_removed_words")
    result = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in wanted if c != "text") + "".join(f", {c} long" for c in counts) + ", kept_sha256 string, text string"

    def run(batches):
        for part in slices(batches, "text"):
            data, at = text_view(part.column(text))
            units = Units(data, at)
            cells = part.column(len(columns)).to_pylist()
            places = [numbers(x) for x in cells]
            hit = np.concatenate(places)
            begin = np.repeat(units.first, [len(x) for x in places]) + (hit >> STEP_BITS)
            gone = covered(begin, begin + (hit & STEP_MASK) + 1, len(units.begin))
            start, stop = units.bytes_of()
            drop = covered(start[gone], stop[gone], len(data))
            sums = np.concatenate(([0], np.cumsum(gone)))
            words = np.concatenate(([0], np.cumsum((units.end - units.begin) * gone)))
            stats = [units.count, sums[units.first + units.count] - sums[units.first], units.words.count, words[units.first + units.count] - words[units.first]]
            whole = part.column(text).to_pylist()
            for r in np.flatnonzero(stats[1]).tolist():
                own = slice(at[r], at[r + 1])
                whole[r] = data[own][~drop[own]].tobytes().decode()
            digests = [hashlib.sha256((t or "").encode()).hexdigest() for t in whole]
            yield pa.record_batch(
                [*(part.column(columns.index(c)) for c in wanted if c != "text"), *(pa.array(x, pa.int64()) for x in stats), pa.array(digests, pa.string()), pa.array(whole, pa.string())],
                names=[*(c for c in wanted if c != "text"), *counts, "kept_sha256", "text"],
            )

    return by_arrow(joined, run, result)
