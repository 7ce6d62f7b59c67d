"""Array kernels shared by the text operators.

Texts arrive as Arrow string columns.  The kernels look at their UTF-8 bytes
through numpy and never build a Python object per word: words are runs of
non-separator bytes, hashed eight bytes at a time with a mixing step after each,
and every pass works on slices of bounded size, so that memory does not depend
on how Spark has filled a batch.  Prefix polynomial sums modulo 2**64 serve the
suffix sort and short spans; texts can be made up that collide under them, so
nothing is removed on their word alone where the texts may be that long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & _MASK)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = splitmix(256, 7) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums of 64-bit codes; one longer than its input."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of the spans [start, end) of a prefix sum."""
    return mix((sums[end] - sums[start]) * powers(len(sums), BASE_INVERSE)[start])


LONG_BLOCKS = 16


def item_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), by their content only.

    Spans of more than ``LONG_BLOCKS`` blocks of eight bytes go through BLAKE2b.
    """
    length = end - start
    out = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(codes) + 1,), "<u8", padded, strides=(1,))
    long = length > 8 * LONG_BLOCKS
    live = np.flatnonzero(~long)
    for k in range(LONG_BLOCKS):
        live = live[length[live] > 8 * k]
        if not len(live):
            break
        rest = np.minimum(length[live] - 8 * k, 8).astype(np.uint64)
        block = blocks[start[live] + 8 * k] << (np.uint64(64) - np.uint64(8) * rest)
        out[live] = mix((out[live] ^ block) * np.uint64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(codes[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``limit`` text bytes, a row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = text_view(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < n:
            end = int(np.searchsorted(at, at[begin] + limit, side="right")) - 1
            end = min(n, max(end, begin + 1))
            yield batch.slice(begin, end - begin)
            begin = end


def byte_table(words: bytes | None = None, separators: bytes | None = None, lower: bool = False) -> np.ndarray:
    """Maps a byte to its (lower-cased) self, or to 0 where it separates words."""
    table = np.arange(256, dtype=np.uint8)
    if separators is not None:
        table[list(separators)] = 0
    else:
        keep = np.zeros(256, bool)
        keep[list(words)] = True
        table[~keep] = 0
    if lower:
        table[65:91] = table[97:123]
    return table


class Words:
    """Words of a slice of texts: byte spans, document numbers and hashes.

    ``table`` must keep every byte from 0x80 on, so that a word ends between
    code points.  A NUL byte is a separator for the tables that name it, else
    it stands for itself through ``nul``.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray, nul: bool = False):
        codes = table[data]
        inside = codes != 0
        if nul:
            inside |= data == 0
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~inside[:-1]
            after[-1], after[:-1] = True, ~inside[1:]
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        first = np.searchsorted(self.start, at)
        self.first, self.count = first[:-1], np.diff(first)
        self.hash = item_hashes(codes, self.start, self.end)
        self.inside = inside

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items (across document edges as well)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + hashes[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)


def gram_spans(first: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the grams inside one document: item positions and document numbers."""
    each = np.maximum(count - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), each)
    skip = np.cumsum(each) - each
    return np.arange(int(each.sum())) - np.repeat(skip, each) + np.repeat(first, each), doc


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


_PLACE = (1 << 30) - 1


def keyed(hashes: np.ndarray) -> np.ndarray:
    """The hashes' high 34 bits above their positions: minima are unique, the leftmost on ties."""
    return (hashes & np.uint64(~_PLACE & _MASK)) | np.arange(len(hashes), dtype=np.uint64)


def place_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(_PLACE)).astype(np.int64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
