"""Changelog lines to change records, with SQL functions and one window per changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .text import stripped

# Markers, words, confidences and patterns of the line rules.
SECTION = r"#?## breaking|breaking changes|breaking:"
SYMBOLS = r"`([a-zA-Z0-9_.$]+)`|\b[a-zA-Z_][a-zA-Z0-9_]*\(\)"
RENAMED = r"(?i)(?:renamed?|moved)\s+[`']?([a-zA-Z0-9_.]+)['`]?\s+(?:to|as|->)\s+[`']?([a-zA-Z0-9_.]+)['`]?"
ARROW = r"[`']([a-zA-Z0-9_.]+)['`]\s*->\s*[`']([a-zA-Z0-9_.]+)['`]"
COMMON_WORDS = ("the", "a", "an", "all", "none")
CONFIDENCE = {"rename": 0.95, "arrow": 0.9, "removed": 0.85, "deprecated": 0.8, "other": 0.8}


def changelog_changes(df: DataFrame, id_column: str = "id", text: str = "changelog") -> DataFrame:
    """``df``: id and changelog.  Rows (id, position, symbol, symbol_new, change_type, description, confidence).

    A line with a breaking marker opens a section and is no record itself; any
    other heading closes it.  Outside a section only bullets count.  The first
    record of a symbol and type stays.
    """
    lines = df.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("at", "raw")).select("id", "at", stripped("raw").alias("line"))
    low = F.lower("line")
    marker = low.rlike(SECTION)
    state = F.when(marker, True).when(low.startswith("#") & ~low.contains("breaking"), False)
    inside = F.coalesce(F.last(state, ignorenulls=True).over(Window.partitionBy("id").orderBy("at")), F.lit(False))
    lines = lines.withColumn("inside", inside).where(~marker & (F.col("inside") | F.col("line").rlike(r"^[-*•]")))
    symbols = F.transform(F.regexp_extract_all("line", F.lit(SYMBOLS), F.lit(0)), lambda s: F.regexp_replace(s, r"[`()]", ""))
    lines = lines.withColumn("symbols", symbols).withColumn("low", F.lower("line"))
    low, some = F.col("low"), F.size("symbols") > 0
    any_of = lambda *words: low.rlike("|".join(words))

    def record(kind, confidence, items, new, *stop):
        kept = F.filter(items, lambda s: ~F.lower(s).isin(*COMMON_WORDS, *stop)) if stop else items
        return F.transform(kept, lambda s: F.struct(s.alias("symbol"), (new(s) if callable(new) else new).cast("string").alias("symbol_new"), kind.alias("change_type"), F.lit(confidence).alias("confidence")))

    one = lambda pattern, group: F.regexp_extract("line", pattern, group)
    changed = F.when(any_of("param", "arg", "signature"), "signature_change").otherwise("behavior_change")
    records = (
        F.when(F.col("line").rlike(RENAMED), record(F.lit("renamed"), CONFIDENCE["rename"], F.array(one(RENAMED, 1)), one(RENAMED, 2)))
        .when(F.col("line").rlike(ARROW), record(F.lit("renamed"), CONFIDENCE["arrow"], F.array(one(ARROW, 1)), one(ARROW, 2)))
        .when(any_of("remove", "dropped", "delete") & some, record(F.lit("removed"), CONFIDENCE["removed"], F.col("symbols"), F.lit(None), "deprecated", "removed"))
        .when(any_of("deprecat") & some, record(F.lit("deprecated"), CONFIDENCE["deprecated"], F.col("symbols"), F.lit(None), "deprecated"))
        .when(F.col("inside") | any_of("signature", "parameter", "argument", "now returns"), record(changed, CONFIDENCE["other"], F.col("symbols"), lambda s: s, "breaking", "change"))
    )
    found = lines.select("id", "at", F.col("line").alias("description"), F.posexplode(records).alias("n", "r")).select("id", "at", "n", "r.*", "description")
    rank = F.row_number().over(Window.partitionBy("id", "symbol", "change_type").orderBy("at", "n"))
    first = found.withColumn("rank", rank).where("rank = 1")
    position = F.row_number().over(Window.partitionBy("id").orderBy("at", "n")) - 1
    return first.select("id", position.alias("position"), "symbol", "symbol_new", "change_type", "description", "confidence")
