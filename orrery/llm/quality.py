"""Quality rules judged by an isolation forest over rule statistics.

A pass over all texts counts the rules' statistics.  Two hard rules reject
outright (fewer than ``MIN_WORDS`` words, or more than half of the words inside
repeated three-word windows).  The rest is judged by path lengths in randomly
split trees: a document that few splits set apart is anomalous.  The trees grow
on a sample of the labelled good rows, at most ``SAMPLE`` of them in the order
of a hash of their ids; the score limit is calibrated on all labelled rows,
through a histogram of fixed size: the limit that best separates bad from good
among those that reject at most ``FALSE_REJECTS`` of the good rows.

Nulls: a null text has no words, so the first rule rejects it.  A null or
unlabelled id takes no part in calibration.  Without good labelled rows (or
with empty tables) only the hard rules judge.  An id labelled twice counts with
its lower quality.  Repeated documents, and rows that repeat an id, each get
their row and are judged alike if their texts are.  Ties in the sample's order
go by id and statistics.  Very long texts are counted whole, one at a time.
Extra columns are ignored unless ``keep`` names them; ``kept_documents`` keeps
columns of any name, those of the statistics included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import apart, by_arrow, written
from .kernels import Words, byte_table, covered, gram_spans, grams, mix, slices, text_view

SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
MIN_WORDS, MAX_REPEATED = 50, 50
SAMPLE, TREES, TREE_ROWS, SEED = 25_600, 100, 256, 20
FALSE_REJECTS, BINS = 0.01, 1000
REACH, FARTHEST = 2.0, 5.0

WORD_TABLE, LINE_TABLE = byte_table(separators=SPACES), byte_table(separators=b"\n")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "word_length", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share")


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, UPPER, DIGIT = _flag(b"#*$%&|<>"), _flag(bytes(range(65, 91))), _flag(bytes(range(48, 58)))
MARK = _flag(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
LEAD = np.array([c & 0xC0 != 0x80 for c in range(256)])


def _distinct(keys: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys per document, and for every key how often its document has it."""
    if not len(keys):
        return np.zeros(n, np.int64), np.zeros(0, np.int64)
    both = mix(keys + mix(docs.astype(np.uint64) + np.uint64(1)))
    _, first, back, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(docs[first], minlength=n), count[back]


def statistics(part: pa.RecordBatch, text: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data, at = text_view(part.column(text))
    n = part.num_rows
    w = Words(data, at, WORD_TABLE, nul=True)
    lines = Words(data, at, LINE_TABLE, nul=True)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[at[1:]] - sums[at[:-1]]

    inside = np.concatenate(([0], np.cumsum(w.inside)))
    worded = inside[lines.end] > inside[lines.start]
    line_doc = lines.doc()[worded]
    n_lines = np.bincount(line_doc, minlength=n)
    distinct_lines, _ = _distinct(lines.hash[worded], line_doc, n)
    spot, doc = gram_spans(w.first, w.count, 3)
    _, times = _distinct(grams(w.hash, 3)[spot], doc, n)
    again = covered(spot[times > 1], spot[times > 1] + 3, len(w.hash))
    sums = np.concatenate(([0], np.cumsum(again)))
    repeats = sums[w.first + w.count] - sums[w.first]
    distinct_words, _ = _distinct(w.hash, w.doc(), n)
    chars = per_doc(LEAD[data] & w.inside)
    symbols = per_doc(SYMBOL[data])
    words, dup = w.count, n_lines - distinct_lines
    some, all_chars = np.maximum(words, 1), np.maximum(chars, 1)
    expected = np.minimum(1.0, 12.0 / np.sqrt(some))  # distinct share falls with length
    features = [
        np.minimum(symbols / some, 3), np.minimum(chars / some, 40), dup / np.maximum(n_lines, 1), repeats / some, per_doc(UPPER[data]) / all_chars,
        np.minimum(per_doc(MARK[data]) / some, 5), per_doc(DIGIT[data]) / all_chars, distinct_words / some / expected,
    ]
    return [words, chars, symbols, dup, repeats], features


@dataclass
class Forest:
    """Trees in flat arrays: feature (-1 in a leaf), split, left child (right is next), path length.

    The trees see each statistic's distance from the sample's median in units of
    its 1 % to 99 % spread, at most ``FARTHEST``.
    """

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    norm: float
    center: np.ndarray
    spread: np.ndarray

    def distances(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(np.abs(rows - self.center) / self.spread, FARTHEST)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 is anomalous."""
        rows = self.distances(rows)
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                right = rows[index, np.maximum(feature, 0)] >= self.split[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.length[node]
        return 2.0 ** (-total / max(len(self.roots), 1) / self.norm)


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    rng = np.random.Generator(np.random.PCG64(seed))
    low, high = np.quantile(rows, [0.01, 0.99], axis=0)
    none = np.zeros(0)
    forest = Forest(none, none, none, none, none, 0.0, np.median(rows, axis=0), np.maximum(high - low, 1e-3))
    rows = forest.distances(rows)
    feature, split, left, length, roots = [], [], [], [], []
    size = min(tree_rows, len(rows))
    limit = int(np.ceil(np.log2(max(size, 2))))
    for _ in range(trees):
        roots.append(len(feature))
        todo = [(rng.choice(len(rows), size, replace=False), 0, len(feature))]
        for x in (feature, split, left, length):
            x.append(-1 if x is feature else 0)
        while todo:
            own, depth, at = todo.pop()
            low, high = rows[own].min(0), rows[own].max(0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(own) < 2 or not len(open_features):
                length[at] = depth + expected_path(len(own))
                continue
            f = int(rng.choice(open_features))
            # Cuts beyond the sample's own range set unseen values apart at once.
            reach = REACH * (high[f] - low[f])
            cut = rng.uniform(low[f] - reach, high[f] + reach)
            feature[at], split[at], left[at] = f, cut, len(feature)
            for side in (own[rows[own, f] < cut], own[rows[own, f] >= cut]):
                for x in (feature, split, left, length):
                    x.append(-1 if x is feature else 0)
                if len(side):
                    todo.append((side, depth + 1, len(feature) - 1))
                else:
                    length[-1] = depth + 1
    return Forest(np.array(feature), np.array(split, float), np.array(left), np.array(length, float), np.array(roots), max(expected_path(size), 1e-9), forest.center, forest.spread)


def limit_from(histogram: list[tuple[int, int, int]], false_rejects: float = FALSE_REJECTS, bins: int = BINS) -> float:
    """From (bin, good rows, bad rows): the score from which on rows are rejected."""
    good, bad = np.zeros(bins + 2), np.zeros(bins + 2)
    for b, g, x in histogram:
        good[b], bad[b] = g, x
    lost = good[::-1].cumsum()[::-1] / max(good.sum(), 1)
    caught = bad[::-1].cumsum()[::-1] / max(bad.sum(), 1)
    gain = np.where(lost <= false_rejects, caught - lost, -1)
    best = np.flatnonzero(gain == gain.max())
    return float(best[-1]) / bins


def sampled(good: DataFrame, id_column: str, sample: int) -> list:
    """The features of at most ``sample`` rows, least by a hash of the id.

    A count first says which share of the hashes is needed, so the tasks send
    little more than the sample and not as many rows each.
    """
    share = min(1.0, (sample + 5 * sample**0.5) / max(good.count(), 1))
    place = F.xxhash64(id_column)
    while True:
        below = good.where(place <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else good
        rows = below.orderBy(place, F.col(id_column), "features").limit(sample).select("features").collect()
        if len(rows) == sample or share >= 1:
            return rows
        share = min(1.0, 2 * share)


def kept_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns whatever their names."""
    inner, columns = apart(docs, id_column, "text")
    return judged(inner, labels, id_column, keep=tuple(inner.columns)).where("kept").select(*columns)


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", keep: tuple[str, ...] = (), sample: int = SAMPLE, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """Per document: the statistics, ``base_failed``, ``score`` (null without a forest) and ``kept``."""
    wanted = list(dict.fromkeys([id_column, *keep]))
    columns = list(dict.fromkeys([*wanted, "text"]))
    kept, text = [columns.index(c) for c in wanted], columns.index("text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in wanted) + "".join(f", {c} long" for c in STATS) + ", features array<float>"

    def run(batches):
        for part in slices(batches, "text"):
            stats, features = statistics(part, text)
            flat = np.stack(features, axis=1).astype(np.float32).ravel()
            offsets = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
            yield pa.record_batch([*(part.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in stats), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*(columns[c] for c in kept), *STATS, "features"])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    facts = written(by_arrow(docs.select(*columns), run, schema).withColumn("base_failed", failed), "quality")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).where("_quality is not null")
    labelled = facts.where(~F.col("base_failed")).join(marks, F.col(id_column) == F.col("_id")).select(id_column, "features", "_quality")
    good = sampled(labelled.where("_quality > 0"), id_column, sample)
    if not good:
        return facts.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed")).drop("features")
    forest = docs.sparkSession.sparkContext.broadcast(grow(np.array([r[0] for r in good], np.float64)))

    def score(batches):
        for batch in batches:
            at = batch.schema.get_field_index("features")
            rows = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            out = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.record_batch([*out, pa.array(forest.value.score(rows))], names=[*(x for x in batch.schema.names if x != "features"), "score"])

    def scored(df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c != "features"]
        return df.mapInArrow(score, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + ", score double")

    bins = scored(labelled).groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(F.count_if(F.col("_quality") > 0).alias("good"), F.count_if(F.col("_quality") <= 0).alias("bad"))
    limit = limit_from([tuple(r) for r in bins.collect()], false_rejects)
    return scored(facts).withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))
