"""Filter interaction audit: what each filter removes, in every order of the filters.

Each text gets a mask of the filters it fails.  All but one filter look at the text alone; the
last one asks for copies.  Rows are routed by the xxhash fingerprint of their text over an RDD:
a task keeps chains of the texts that share a fingerprint, with the full text and the least id
of each, and emits the rows that are not the least.  This runs once where the rows are read
(so that a task sends one row per text, whatever the number of copies) and once behind the
shuffle, sorted by fingerprint, so that one chain is in memory at a time.  Rows that are known to be copies
travel without their text.  ``combineByKey`` then merges vectors of counts by mask, one per
part, and the orders are read off the vectors.

Nulls: a null text is the empty one, a null part the empty string.  A null id is later than
every other id and has no label.  Ties: rows of the least id of a text are no copies, however
many; labels of one id count as good (toxic) if any of them does.  Repeated rows count each.
An empty table gives no rows.  A very long text is held by one task at a time, compressed in
the shuffle.  Columns other than id, part and text are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

from .common import partitions

HELD_BYTES, PART_BYTES = 32 << 20, 64 << 20
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]")
CONTINUED = bytes(range(0x80, 0xC0))


def short(raw: bytes) -> bool:
    """Under 200 words."""
    return len(raw.split()) < 200


def repetitive(raw: bytes) -> bool:
    """Fewer than half of the words are distinct."""
    words = raw.split()
    return 100 * len(set(words)) < 50 * len(words)


def shouting(raw: bytes) -> bool:
    """More than 2 % of the code points are capitals from A to Z."""
    return 100 * (len(raw) - len(raw.translate(None, UPPER))) > 2 * len(raw.translate(None, CONTINUED))


def marked(raw: bytes) -> bool:
    """Holds one of ``# $ % & * |``."""
    return MARKS.search(raw) is not None


#: Filters by letter, in the order of their bits; words are split at ASCII white space, as ``bytes.split`` does.
FILTERS: dict[str, Callable[[bytes], bool]] = {"A": short, "B": repetitive, "C": shouting, "D": marked}
COPIES = "E"


def later(one: object, other: object) -> bool:
    """Whether the first id comes after the second; a null id comes last."""
    return other is not None and (one is None or one > other)


class Chains:
    """Texts by fingerprint: each with the least id seen and the rows of that id by part."""

    def __init__(self) -> None:
        self.chains: dict[bytes, list[list]] = {}
        self.held = 0

    def add(self, key: bytes, text: bytes, doc_id: object, mask: int, parts: Counter) -> tuple | None:
        """Takes rows of one id and text; returns the rows (id, mask, parts) that turn out to be copies of an earlier one."""
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                if later(doc_id, entry[1]):
                    return doc_id, mask, parts
                if later(entry[1], doc_id):
                    copies = entry[1], mask, entry[3]
                    entry[1], entry[3] = doc_id, parts
                    return copies
                entry[3] += parts
                return None
        chain.append([text, doc_id, mask, parts])
        self.held += len(text)
        return None

    def least(self) -> Iterator[tuple]:
        """Fingerprint, text, id, mask and parts of the least rows; the chains are empty afterwards."""
        for key, chain in self.chains.items():
            for entry in chain:
                yield key, *entry
        self.chains, self.held = {}, 0


def routed(filters: dict[str, Callable[[bytes], bool]], held_bytes: int, digest: Callable[[bytes], bytes]) -> Callable[[int, Iterator], Iterator]:
    """First pass over a task's rows (id, part, text): copies without text under keys that spread, the rest with it under the fingerprint."""

    def run(index: int, rows: Iterator) -> Iterator:
        chains, pack = Chains(), zstandard.ZstdCompressor(level=1)
        numbers = itertools.count()
        packed = lambda: ((key, (doc_id, mask, dict(parts), pack.compress(text))) for key, text, doc_id, mask, parts in chains.least())
        for doc_id, part, text in rows:
            raw = (text or "").encode()
            mask = sum(1 << bit for bit, fails in enumerate(filters.values()) if fails(raw))
            if copies := chains.add(digest(raw), raw, doc_id, mask, Counter([part or ""])):
                yield b"copy" + digest(b"%d:%d" % (index, next(numbers))), (*copies[:2], dict(copies[2]), None)
            if chains.held > held_bytes:
                yield from packed()
        yield from packed()

    return run


def settled(copy_bit: int) -> Callable[[Iterator], Iterator]:
    """Second pass: rows sorted by fingerprint to (id, part, mask, rows)."""

    def run(rows: Iterator) -> Iterator:
        unpack = zstandard.ZstdDecompressor()
        for key, group in itertools.groupby(rows, key=lambda row: row[0]):
            chains = Chains()
            for _, (doc_id, mask, parts, text) in group:
                found = (doc_id, mask, parts) if text is None else chains.add(key, unpack.decompress(text), doc_id, mask, Counter(parts))
                if found:
                    yield from ((found[0], part, found[1] | copy_bit, n) for part, n in found[2].items())
            for _, _, doc_id, mask, parts in chains.least():
                yield from ((doc_id, part, mask, n) for part, n in parts.items())

    return run


def fingerprint(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def parts_for(docs: DataFrame) -> int:
    """Partitions behind the shuffle: what the session sets, and more where the texts would exceed ``PART_BYTES`` in one."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs), -(-volume // PART_BYTES))


def masks(docs: DataFrame, part: str = "source", filters: dict[str, Callable[[bytes], bool]] = FILTERS, held_bytes: int = HELD_BYTES, digest: Callable[[bytes], bytes] = fingerprint) -> DataFrame:
    """Id, part and mask of the filters failed, with the number of rows of which this holds.

    The bit after those of ``filters`` is that of the copies.  ``docs`` must give the same rows whenever it is read (a table does).
    """
    rows = docs.select("doc_id", part, "text").rdd.mapPartitionsWithIndex(routed(filters, held_bytes, digest))
    dealt = rows.repartitionAndSortWithinPartitions(parts_for(docs), lambda key: xxhash.xxh3_64_intdigest(key))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, n long"
    return docs.sparkSession.createDataFrame(dealt.mapPartitions(settled(1 << len(filters))), schema, verifySchema=False)


def vectors(found: DataFrame, labels: DataFrame, size: int, parts: int) -> RDD:
    """(part, counts): rows by mask, of them good ones, of them toxic ones."""
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = found.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))).rdd

    def merged(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    return rows.map(lambda row: (row[0], tuple(row[1:]))).combineByKey(lambda row: merged(np.zeros((3, size), np.int64), row), merged, lambda one, other: one + other, parts)


def orders(letters: str) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(order, step, filter's bit) of every step of every order, and for each of them which masks it keeps, removes, finds removed, and which fail its filter alone."""
    steps, found = [], []
    every = np.arange(1 << len(letters))
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, bit in enumerate(order, 1):
            fails, gone = every >> bit & 1 == 1, every & before != 0
            before |= 1 << bit
            steps.append(("".join(letters[i] for i in order), step, bit))
            found.append((every & before == 0, fails & ~gone, fails & gone, every == 1 << bit))
    return steps, np.array(found, np.int64)


def reported(letters: str) -> Callable[[tuple], Iterator[tuple]]:
    """All steps of all orders of one part, from its vectors."""

    def run(row: tuple) -> Iterator[tuple]:
        part, counts = row
        steps, selects = orders(letters)
        kept, removed, redundant, alone = (selects[:, i] @ counts[0] for i in range(4))
        good, toxic = selects[:, 1] @ counts[1], selects[:, 1] @ counts[2]
        share = np.zeros(len(letters), np.int64)
        np.add.at(share, [bit for _, _, bit in steps], removed)
        for at, (order, step, bit) in enumerate(steps):
            yield (part, order, step, *(int(x[at]) for x in (kept, removed, redundant, alone, good, toxic)), int(share[bit]))

    return run


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, Callable[[bytes], bool]] = FILTERS, copies: str = COPIES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per part, order of the filters and step; ``filters`` (of one letter each) look at a text's bytes, ``copies`` is the letter of the filter for copies.

    At most seven filters in all, as every order is reported.
    """
    letters = "".join([*filters, copies])
    if len(letters) > 7 or len(set(letters)) != len(filters) + 1:
        raise ValueError("filters need distinct names of one letter, seven in all at most")
    parts = partitions(docs)
    counts = vectors(masks(docs, part, filters, held_bytes), labels, 1 << len(letters), parts)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(counts.flatMap(reported(letters)), schema, verifySchema=False)
