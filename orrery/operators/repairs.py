"""Patches without a language model, and what keeps a pull request from being opened.

A provider takes rows and adds ``diff``, which is the sentinel where it has no
answer.  Others can be registered; the first answer of an order counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SENTINEL, log_sha

Provider = Callable[[DataFrame], DataFrame]


def renamed(df: DataFrame) -> DataFrame:
    """``df``: path, line_start, snippet (whole lines), symbol, symbol_new.  The diff that renames the symbol as a whole word.

    Symbols with other characters than those of dotted names, and snippets
    without the symbol, give the sentinel.
    """
    plain = r"^[A-Za-z0-9_.$]+$"
    pattern = F.concat(F.lit(r"(?<![\w$])\Q"), F.col("symbol"), F.lit(r"\E(?![\w$])"))
    after = F.regexp_replace(F.col("snippet"), pattern, F.replace(F.col("symbol_new"), F.lit("$"), F.lit("\\$")))
    marked = lambda text, mark: F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + ("\\+" if mark == "+" else mark)))
    lines = F.size(F.split("snippet", "\n")).cast("string")
    span = F.concat(F.col("line_start").cast("string"), F.lit(","), lines)
    diff = F.concat(F.lit("--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.lit("\n@@ -"), span, F.lit(" +"), span, F.lit(" @@\n"), marked(F.col("snippet"), "-"), F.lit("\n"), marked(after, "+"), F.lit("\n"))
    usable = F.col("symbol").rlike(plain) & F.col("symbol_new").rlike(plain) & (after != F.col("snippet"))
    return df.withColumn("diff", F.when(F.coalesce(usable, F.lit(False)), diff).otherwise(SENTINEL))


PROVIDERS: dict[str, Provider] = {"rename": renamed}


def provider(name: str | None = None) -> Provider:
    """A registered provider by name, in any case; the renaming one by default."""
    key = (name or "rename").strip().lower()
    if key not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[key]


def patched(df: DataFrame, order: tuple[str, ...] = ("rename",)) -> DataFrame:
    """``diff`` of the first provider in the order that has an answer, else the sentinel."""
    answers = []
    for k, name in enumerate(order):
        df = provider(name)(df).withColumnRenamed("diff", f"_diff{k}")
        answers.append(F.when(F.col(f"_diff{k}") != SENTINEL, F.col(f"_diff{k}")))
    return df.withColumn("diff", F.coalesce(*answers, F.lit(SENTINEL))).drop(*(f"_diff{k}" for k in range(len(order))))


def drifted(asked_base: Column, log: Column, head: Column) -> Column:
    """Whether the branch has left the commit that was validated: the one asked for, else the one in the log; an unknown one has not."""
    base = F.coalesce(F.nullif(asked_base, F.lit("")), log_sha(log, "base"))
    return F.coalesce(base != head, F.lit(False))


def pr_decisions(requests: DataFrame, prs: DataFrame) -> DataFrame:
    """Adds ``decision``: duplicate if a pull request is open for the repository and version, drifted, else open.

    ``requests``: id, repo_id, version_id, asked_base, log, head.  Requests
    without a version are not duplicates here; their patches are compared by
    ``open_pr_guard``.
    """
    held = prs.where((F.col("status") == "open") & F.col("version_id").isNotNull()).select("repo_id", "version_id").distinct().withColumn("held", F.lit(True))
    decision = F.when(F.col("held"), "duplicate").when(drifted(F.col("asked_base"), F.col("log"), F.col("head")), "drifted").otherwise("open")
    return requests.join(held, ["repo_id", "version_id"], "left").withColumn("decision", decision).drop("held")
