"""Line dedup: a line found in several documents stays in the first of them only.

Each line's key is hashed to two words.  The hashes are range-partitioned and sorted by
document and position within, so that the first document of a key passes first and every
later one is told by a running ``first``; the text itself is never shuffled for it.  What
comes back is a run-length keep bitmap per document, which is then applied to its text.

A key with more lines than a share of one partition would put them into one task.  Such keys
are looked for with a bounded sketch over all lines; their first documents are aggregated
before the shuffle (at most ``HOT_KEYS`` rows, broadcast) and their lines are judged where
they are.  What the sketch finds changes the route of a line, never its verdict.

Nulls: a null text is one empty line.  Rows of one id are one document; rows of a null id are
one too, and the last.  Ties: repeated lines of the first document all stay.  Repeated rows
have one bitmap, which each of them gets.  An empty table gives no rows.  A very long text is
split where it stands; only hashes and runs of it travel.  Extra columns are kept; where one is
called ``n_lines`` or ``n_dropped``, the new column gets underscores before its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import apart, partitions, written

MIN_CHARS, HOT_KEYS, TRACKED = 10, 1024, 16384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def two_words(value: Column) -> list[Column]:
    """128 bits of hash: no two of 10^12 values are likely to share them."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the two words ``_t1``, ``_t2`` that tell rows of one id apart."""
    first, second = two_words(F.coalesce("text", F.lit("")))
    return docs.withColumns({"_t1": first, "_t2": second})


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes and places of the lines long enough to be judged, of rows that ``identified`` gives."""
    each = docs.select("doc_id", "_t1", "_t2", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    keyed = each.select("doc_id", "_t1", "_t2", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    first, second = two_words(F.col("key"))
    return keyed.select(first.alias("h1"), second.alias("h2"), "doc_id", "_t1", "_t2", "at")


def hot_hashes(lines: DataFrame, share: int) -> list[int]:
    """First words of keys that may hold more than one in ``share`` of the lines, at most ``HOT_KEYS``."""
    total, top = lines.agg(F.count("*"), F.expr(f"approx_top_k(h1, {HOT_KEYS}, {TRACKED})")).first()
    return [found.item for found in top or [] if found["count"] * share > total]


def later_lines(lines: DataFrame, share: int | None = None) -> DataFrame:
    """The lines whose key an earlier document holds.  Keys above one in ``share`` lines (by default four times the partitions) are judged without a shuffle of their lines."""
    parts = partitions(lines)
    hot = hot_hashes(lines, share or 4 * parts)
    rows = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "_t1", "_t2", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = lines.where(~F.col("h1").isin(hot)) if hot else lines
    found = ranged.repartitionByRange(parts, "h1", "h2").withColumn("first", F.first("doc_id").over(rows))
    if hot:
        part = lines.where(F.col("h1").isin(hot))
        found = found.unionByName(part.join(F.broadcast(part.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))), ["h1", "h2"]))
    return found.where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "_t1", "_t2", "at")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, share: int | None = None) -> DataFrame:
    """Rows with lines to drop (id and words of the text): the runs of zeros of the keep bitmap, by the ``first`` and the ``last`` line of each."""
    lines = written(lines_of(docs, min_chars), "lines")
    places = later_lines(lines, share).groupBy("doc_id", "_t1", "_t2").agg(F.sort_array(F.collect_set("at")).alias("p"))
    first = "filter(p, (x, i) -> coalesce(get(p, i - 1) < x - 1, true))"
    last = "filter(p, (x, i) -> coalesce(get(p, i + 1) > x + 1, true))"
    return places.select("doc_id", "_t1", "_t2", F.expr(first).alias("first"), F.expr(last).alias("last"))


def kept_text(lines: str, first: str, last: str) -> Column:
    """The lines outside the runs, joined again."""
    gaps = f"transform(concat(array(-1), {last}), (a, i) -> named_struct('a', a, 'b', coalesce(get({first}, i), size({lines}))))"
    return F.expr(f"array_join(flatten(transform(filter({gaps}, g -> g.b - g.a > 1), g -> slice({lines}, g.a + 2, g.b - g.a - 1))), '\\n')")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, share: int | None = None) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, the number of lines before and the number dropped."""
    inner, back = apart(docs, "doc_id", "text")
    inner = identified(inner)
    bitmaps = keep_bitmaps(inner.select("doc_id", "text", "_t1", "_t2"), min_chars, share).toDF("_id", "_b1", "_b2", "_first", "_last")
    joined = inner.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_b1")) & (F.col("_t2") == F.col("_b2")), "left")
    whole = F.coalesce("text", F.lit(""))
    counts = joined.withColumn("_lines", F.split(whole, "\n")).withColumns(
        {
            "_kept": F.when(F.col("_first").isNull(), whole).otherwise(kept_text("_lines", "_first", "_last")),
            "_n": F.size("_lines").cast("long"),
            "_gone": F.coalesce(F.expr("aggregate(_last, 0L, (a, x) -> a + x) - aggregate(_first, 0L, (a, x) -> a + x) + size(_first)"), F.lit(0).cast("long")),
        }
    )
    names = []
    for name in ("n_lines", "n_dropped"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name = f"_{name}"
        names.append(name)
    columns = [F.col("_kept").alias(c) if c == "text" else column for c, column in zip(docs.columns, back, strict=True)]
    return counts.select(*columns, F.col("_n").alias(names[0]), F.col("_gone").alias(names[1]))
