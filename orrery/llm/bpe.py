"""Byte-level BPE as a streaming transducer with bounded lookahead.

A merge list is *proper* when every merge combines tokens made by earlier
merges and no token is made twice.  Then whether a merge happens at a place
depends on a bounded stretch of bytes to its right: a merge of rank r can only
be prevented by a merge of lower rank that takes its right half away, and so on
down a chain of falling ranks.  ``lookahead`` computes the longest such stretch
over the whole list.  The encoder keeps a buffer of undecided bytes, merges it,
and emits every token that ends at least that many bytes before the buffer's
end: no later byte can change it.  A token boundary that is final splits the
text into independent halves, so emitted bytes are dropped and the buffer never
exceeds the lookahead plus one block, however long the text is.

Decoding is a state machine from token bytes to text that carries at most three
bytes of an unfinished code point between tokens.

Nulls count as the empty text.  The empty text has no tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_arrow

# The public splitting pattern's classes and contractions.  The pattern is
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
CLASSES = (r"\s", r"\p{L}", r"\p{N}")
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
BLOCK_CHARS = 1 << 16
MEMO_ITEMS, MEMO_CHARS = 500_000, 48
LOW = (1 << 32) - 1


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A tokenizer file's merges as ids, with the lookahead that suffices for them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.byte_id = {letters[t]: i for t, i in model["vocab"].items() if len(t) == 1}
        self.rank: dict[int, int] = {}  # (left id, right id) to (rank, made id), each pair in one number
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.rank[model["vocab"][a] << 32 | model["vocab"][b]] = r << 32 | model["vocab"][a + b]
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """need[t]: bytes past t's end that decide whether t is made at a place."""
        length = {i: len(b) for i, b in self.bytes_of.items()}
        need = dict.fromkeys(self.byte_id.values(), 0)
        after: dict[int, int] = {}  # per token: most bytes past its end that an already seen merge with a right neighbour needs
        longest = 0
        for pair, merge in self.rank.items():
            a, b, made = pair >> 32, pair & LOW, merge & LOW
            if a not in need or b not in need or made in need:
                raise ValueError("the merge list is not proper: no lookahead can be given")
            need[made] = max(0, need[a] - length[b], need[b], after.get(b, 0))
            reach = length[b] + need[made]
            after[a] = max(after.get(a, 0), length[b] + need[b])
            longest = max(longest, reach)
        return longest

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges in order of rank, from the left within a rank."""
        get, none = self.rank.get, 1 << 63
        if len(ids) <= 64:
            ids = list(ids)
            found = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            while found and (best := min(found)) != none:
                i = found.index(best)
                made = ids[i] = best & LOW
                del ids[i + 1], found[i]
                if i:
                    found[i - 1] = get(ids[i - 1] << 32 | made, none)
                if i < len(found):
                    found[i] = get(made << 32 | ids[i + 1], none)
            return ids
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        ids = list(ids)
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            made = ids[i] = m & LOW
            alive[j], right[i] = False, right[j]
            if (j := right[i]) >= 0:
                left[j] = i
                if m := get(made << 32 | ids[j]):
                    heapq.heappush(heap, (m, i, made, ids[j]))
            if (p := left[i]) >= 0 and (m := get(ids[p] << 32 | made)):
                heapq.heappush(heap, (m, p, ids[p], made))
        return [x for x, keep in zip(ids, alive, strict=True) if keep]


class Transducer:
    """Bytes in, stable token ids out."""

    def __init__(self, merges: Merges, block: int = 4096):
        self.merges, self.block, self.buffer = merges, block, bytearray()

    def feed(self, data: bytes) -> list[int]:
        """The ids that have become stable."""
        out: list[int] = []
        for at in range(0, len(data), self.block):
            self.buffer += data[at : at + self.block]
            if len(self.buffer) > self.merges.lookahead + self.block:
                out += self._stable(len(self.buffer) - self.merges.lookahead)
        return out

    def finish(self) -> list[int]:
        """The rest: the end of the text is known."""
        out = self.merges.merge([self.merges.byte_id[x] for x in self.buffer])
        self.buffer.clear()
        return out

    def _stable(self, limit: int) -> list[int]:
        merges, done, out = self.merges, 0, []
        for token in merges.merge([merges.byte_id[x] for x in self.buffer]):
            end = done + len(merges.bytes_of[token])
            if end > limit:
                break
            done = end
            out.append(token)
        del self.buffer[:done]
        return out


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Per code point: 1 white space, 2 letter, 3 number, 0 other."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for first, end in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(first, end)))
            for k, cls in enumerate(CLASSES, 1):
                for m in regex.finditer(f"{cls}+", every):
                    table[first + m.start() : first + m.end()] = k
        _classes.append(table)
    return _classes[0]


def piece_starts(text: str) -> np.ndarray:
    """Where the splitting pattern's matches begin in a text that isn't empty.

    Pieces are runs of one class.  Of white space before something else the
    last character stands apart, and joins what follows if it is a space.  A
    run of others that begins with an apostrophe, no space before it, gives way
    to a contraction.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = char_classes()[codes]
    n = len(codes)
    starts = np.empty(n, bool)
    starts[0] = True
    starts[1:] = cls[1:] != cls[:-1]
    turn = np.flatnonzero(starts[1:] & (cls[:-1] == 1)) + 1  # first characters after white space
    starts[turn - 1] = True
    starts[turn[codes[turn - 1] == 32]] = False
    for at in np.flatnonzero(starts & (codes == 39)).tolist():
        if at + 1 < n and cls[at + 1] == 2:
            for tail in CONTRACTIONS:
                if text.startswith(tail, at + 1):
                    starts[at + 1] = False
                    if at + 1 + len(tail) < n:
                        starts[at + 1 + len(tail)] = True
                    break
    return np.flatnonzero(starts)


class Encoder(dict):
    """Text to ids.  As a dict it remembers short pieces' ids as little-endian bytes."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        self.packed = {t: i.to_bytes(4, "little") for t, i in merges.special.items()}

    def __missing__(self, piece: str) -> bytes:
        transducer = Transducer(self.merges)
        ids = transducer.feed(piece.encode()) + transducer.finish()
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ITEMS:
                self.clear()
            self[piece] = ids
        return ids

    def _stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def blocks(self, text: str) -> Iterator[bytes]:
        """Packed ids of successive blocks of pieces; joined they are the text's ids."""
        for stretch, special in self._stretches(text):
            if special:
                yield self.packed[stretch]
                continue
            at, size = 0, BLOCK_CHARS
            while at < len(stretch):
                block = stretch[at : at + size]
                cuts = piece_starts(block).tolist()
                if at + size < len(stretch):
                    if len(cuts) < 3:  # within a very long piece
                        size *= 2
                        continue
                    cuts.pop()  # the last piece may go on, and the start before it is sure
                else:
                    cuts.append(len(block))
                if size > BLOCK_CHARS:
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        yield from self._long(block, a, b)
                else:
                    yield b"".join([self[block[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)])
                at, size = at + cuts[-1], BLOCK_CHARS

    def _long(self, text: str, start: int, end: int) -> Iterator[bytes]:
        """A piece of any length, block by block through the transducer."""
        transducer = Transducer(self.merges)
        for at in range(start, end, BLOCK_CHARS):
            yield np.array(transducer.feed(text[at : min(end, at + BLOCK_CHARS)].encode()), "<u4").tobytes()
        yield np.array(transducer.finish(), "<u4").tobytes()


class Decoder:
    """Token ids to text; invalid bytes become U+FFFD, as in a lossy UTF-8 reading."""

    def __init__(self, merges: Merges):
        parts = [merges.bytes_of.get(i, b"") for i in range(max(merges.bytes_of) + 1)]
        self.length = np.array([len(x) for x in parts], np.int32)
        self.first = np.cumsum(self.length) - self.length
        self.all = np.frombuffer(b"".join(parts), np.uint8)

    def blocks(self, packed: Iterator[bytes]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in packed:
            ids = np.frombuffer(block, "<u4")
            each = self.length[ids]
            ends = np.cumsum(each)
            yield machine.decode(self.all[np.repeat(self.first[ids] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        yield machine.decode(b"", final=True)


_loaded: dict[str, tuple[Encoder, Decoder]] = {}


def tokenizer(path: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a file, once per Python worker."""
    if path not in _loaded:
        merges = Merges(path)
        _loaded[path] = Encoder(merges), Decoder(merges)
    return _loaded[path]


def tokenized(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The kept columns with token ids (unless ``ids`` is false), their number and digests of ids and of the decoded text.

    ``path`` names the tokenizer file on the workers.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    text = columns.index("text")
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        encoder, decoder = tokenizer(path)
        for batch in batches:
            counts, first, second, out = [], [], [], []
            for value in batch.column(text):
                packed, n, kept = hashlib.sha256(), 0, []

                def through(value=value.as_py() or "", packed=packed, kept=kept):
                    for block in encoder.blocks(value):
                        packed.update(block)
                        kept.append(block if ids else len(block))
                        yield block

                decoded = hashlib.sha256()
                for piece in decoder.blocks(through()):
                    decoded.update(piece.encode())
                n = (sum(map(len, kept)) if ids else sum(kept)) // 4
                counts.append(n)
                first.append(packed.hexdigest())
                second.append(decoded.hexdigest())
                if ids:
                    out.append(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
            columns_out = [batch.column(columns.index(c)) for c in keep] + [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            if ids:
                columns_out.append(pa.array(out, pa.list_(pa.int32())))
            yield pa.record_batch(columns_out, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    return by_arrow(docs.select(*columns), run, schema)
