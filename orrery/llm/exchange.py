"""Fingerprints of a corpus, exchanged in packets.

A task gathers the fingerprints of some megabytes of text, resolves among
themselves those that it can, and sends the rest as one packed row per bucket.
So a fingerprint crosses the network once per chunk of text, not once per
occurrence, and however common it is, its bucket gets one entry from each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_arrow, partitions
from .kernels import slices

CHUNK_BYTES = 8 << 20


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of non-negative integers, byte plane by byte plane (this compresses well)."""
    wide = np.ascontiguousarray(values).astype("<u8", copy=False)
    return np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width if width else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def integer_ids(df: DataFrame, id_column: str) -> F.Column:
    """The id as a long; packets hold no other type."""
    kind = df.schema[id_column].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_column} must be an integer, not {kind}")
    return F.col(id_column).cast("long")


def row_tags(df: DataFrame, id_column: str) -> F.Column:
    """What tells rows of one id apart: a hash of the text, or 0 for all where no id repeats."""
    repeated = df.where(F.col(id_column).isNotNull()).groupBy(id_column).count().where("count > 1")
    return F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")


def pack_docs(docs: np.ndarray) -> bytes:
    """Sorted ids as runs: number of runs, first differences, lengths."""
    cut = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    each = np.diff(np.concatenate((cut, [len(docs)])))
    steps = np.diff(docs[cut], prepend=np.int64(0))
    return np.int64(len(cut)).tobytes() + planes(steps.view(np.uint64), 8) + planes(each, 4)


def unpack_docs(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.repeat(np.cumsum(unplanes(data[8 : 8 + 8 * n], 8).view(np.int64)), unplanes(data[8 + 8 * n :], 4).astype(np.int64))


def packets(bucket: np.ndarray, docs: np.ndarray, columns: list[tuple[np.ndarray, int]], part: int = 0, blobs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """One row per bucket: bucket, part, docs and columns; rows of a bucket in the order of docs.

    ``blobs``: bytes with the entries' starts and lengths, sent along as one compressed binary.
    """
    order = np.lexsort((docs, bucket))
    keys, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(order))[: len(keys)]
    rows = [order[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    out = [pa.array(keys, pa.int32()), pa.array(np.full(len(keys), part), pa.int32()), pa.array([pack_docs(docs[r]) for r in rows], pa.binary())]
    out += [pa.array([planes(values[r], width) for r in rows], pa.binary()) for values, width in columns]
    if blobs is not None:
        data, start, length = blobs
        out.append(pa.array([pa.compress(data[spread(start[r], length[r])].tobytes(), "zstd", asbytes=True) for r in rows], pa.binary()))
        out.append(pa.array([int(length[r].sum()) for r in rows], pa.int64()))
    return pa.record_batch(out, names=["bucket", "part", "docs", *(f"c{i}" for i in range(len(columns))), *["blob", "size"] * (blobs is not None)])


def bucket_keys(df: DataFrame) -> np.ndarray:
    """One number for each shuffle partition, such that Spark's hash sends it there: buckets spread evenly."""
    n = partitions(df)
    homes = df.sparkSession.range(32 * n + 256).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("home"))
    keys = dict(homes.groupBy("home").agg(F.min("key")).collect())
    return np.array([keys.get(b, b) for b in range(n)], np.int64)


def schema(columns: int, blob: bool = False) -> str:
    return "bucket int, part int, docs binary" + "".join(f", c{i} binary" for i in range(columns)) + ", blob binary, size long" * blob


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def received(batches: Iterator[pa.RecordBatch], widths: dict[int, tuple[int, ...]], blob: bool = False) -> dict[int, list]:
    """All packets of a partition, by part: docs, columns (and bytes) put together."""
    parts: dict[int, list[list]] = {p: [[] for _ in range(1 + len(w) + blob)] for p, w in widths.items()}
    for batch in batches:
        for r, p in enumerate(batch.column(1).to_pylist()):
            own = parts[p]
            own[0].append(unpack_docs(batch.column(2)[r].as_py()))
            for i, width in enumerate(widths[p]):
                own[1 + i].append(unplanes(batch.column(3 + i)[r].as_py(), width))
            if blob:
                size = batch.column(batch.num_columns - 1)[r].as_py()
                own[-1].append(np.frombuffer(pa.decompress(batch.column(batch.num_columns - 2)[r].as_buffer(), size, "zstd"), np.uint8))
    empty = [np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * max(map(len, widths.values()))]
    return {p: [np.concatenate(x) if x else (np.zeros(0, np.uint8) if blob and i == len(own) - 1 else empty[min(i, 1)]) for i, x in enumerate(own)] for p, own in parts.items()}


def chunks(batches: Iterator[pa.RecordBatch], look: Callable[[pa.RecordBatch], list[np.ndarray]], limit: int = CHUNK_BYTES) -> Iterator[list[np.ndarray]]:
    """``look`` over slices of (id, text), its arrays put together for about ``limit`` bytes of text."""
    held, size = [], 0
    for part in slices(batches):
        held.append(look(part))
        size += part.nbytes
        if size >= limit:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def exchanged(docs: DataFrame, send, columns: int, receive, out: str, blob: bool = False) -> DataFrame:
    """``send`` makes packets from rows, ``receive`` gets those of a set of buckets."""
    sent = by_arrow(docs, send, schema(columns, blob))
    return sent.repartition(partitions(docs), "bucket").mapInArrow(receive, out)


def per_document(sent: DataFrame, parts: dict[int, dict[str, int]]) -> DataFrame:
    """One row (id, tag, numbers) for each document that packets name.

    ``parts``: the columns of each kind of packet and their widths, after the
    tags; a width of 0 is padding.  A cell holds its column's numbers as 32-bit ones, in one order for all
    columns of a kind.
    """
    names = [name for columns in parts.values() for name, width in columns.items() if width]

    def run(batches):
        got = received(batches, {p: (8, *columns.values()) for p, columns in parts.items()})
        ids, tags = (np.concatenate([got[p][i] for p in parts]) for i in (0, 1))
        kind = np.repeat(np.arange(len(parts)), [len(got[p][0]) for p in parts])
        order = np.lexsort((tags, ids))
        ids, tags, kind = ids[order], tags[order], kind[order]
        first = np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))) if len(ids) else np.zeros(0, bool)
        group, n = np.cumsum(first) - 1, int(first.sum())
        cells, base = [], 0
        for k, p in enumerate(parts):
            own = order[kind == k] - base
            ends = 4 * np.cumsum(np.bincount(group[kind == k], minlength=n))
            offsets = pa.py_buffer(np.concatenate(([0], ends)).astype("<i4"))
            cells += [pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(v[own].astype("<i4"))]) for v, width in zip(got[p][2:], parts[p].values(), strict=True) if width]
            base += len(got[p][0])
        yield pa.record_batch([pa.array(ids[first], pa.int64()), pa.array(tags[first].view(np.int64)), *cells], names=["id", "tag", *names])

    return sent.repartition(partitions(sent), "bucket").mapInArrow(run, "id long, tag long" + "".join(f", {n} binary" for n in names))


def numbers(cell: bytes | None) -> np.ndarray:
    return np.frombuffer(cell or b"", "<i4").astype(np.int64)
