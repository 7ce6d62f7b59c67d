"""Unified diffs: structural checks as column functions, application as an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .text import stripped

DRIFT = (25, 24)
RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("content", T.StringType()), T.StructField("log", T.StringType())])
HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def structure(diff: str, snippet: str):
    """struct(applies, parses, scope): hunk or file headers, changed lines, and a removed line that meets the snippet.

    Without removed lines, or without a snippet, any scope is fine.
    """
    lines = F.split(F.col(diff), r"\r\n|\n|\r")
    trimmed = lambda s: stripped(F.substring(s, 2, 1_000_000))
    minus = F.transform(F.filter(lines, lambda s: s.startswith("-") & ~s.startswith("---")), trimmed)
    plus = F.filter(lines, lambda s: s.startswith("+") & ~s.startswith("+++"))
    starts = lambda mark: F.exists(lines, lambda s: s.startswith(mark))
    shaped = F.coalesce((F.length(diff) >= 10) & (F.col(diff) != "UNABLE_TO_PATCH") & (starts("@@") | (starts("---") & starts("+++"))) & (F.size(minus) + F.size(plus) > 0), F.lit(False))
    known = F.filter(F.transform(F.split(F.coalesce(F.col(snippet), F.lit("")), r"\r\n|\n|\r"), stripped), lambda s: s != "")
    meets = F.exists(F.filter(minus, lambda m: m != ""), lambda m: F.exists(known, lambda k: k.contains(m) | m.contains(k)))
    scope = shaped & ((F.size(minus) == 0) | (F.size(known) == 0) | meets)
    return F.struct(shaped.alias("applies"), scope.alias("parses"), scope.alias("scope"))


def hunks_of(diff: str) -> list[dict]:
    """Hunks with declared counts and the lines that belong to them; what follows a full hunk is ignored."""
    found: list[dict] = []
    for line in diff.splitlines():
        m = HUNK.match(line)
        if m:
            start, old, _, new = m.groups()
            found.append({"at": int(start), "old": 1 if old is None else int(old), "new": 1 if new is None else int(new), "before": [], "after": []})
        elif found and (len(found[-1]["before"]) < found[-1]["old"] or len(found[-1]["after"]) < found[-1]["new"]):
            mark, body = line[:1], line[1:]
            if mark in ("-", " "):
                found[-1]["before"].append(body)
            if mark in ("+", " "):
                found[-1]["after"].append(body)
    return found


def nearest(lines: list[str], wanted: list[str], target: int) -> int | None:
    """The place of ``wanted``: the target, else the nearest one within the drift, the earlier on ties."""
    places = [target] if 0 <= target <= len(lines) else []
    around = range(max(0, target - DRIFT[0]), min(len(lines) - len(wanted), target + DRIFT[1]) + 1)
    places += sorted(around, key=lambda p: (abs(p - target), p))
    return next((p for p in places if lines[p : p + len(wanted)] == wanted), None)


def applied(original: str, diff: str, ignore_space: bool = False) -> tuple[bool, str, str]:
    """(ok, content, log).  Fails closed: any hunk that does not fit leaves the content as it was."""
    if not diff or not diff.strip():
        return False, original, "empty diff"
    hunks = hunks_of(diff)
    if not hunks:
        return False, original, "no hunks"
    crlf = "\r\n" in original
    text = original.replace("\r\n", "\n")
    ended = text.endswith("\n")
    lines = text.split("\n")[: -1 if ended else None] if text else []
    view = (lambda xs: [" ".join(x.split()) for x in xs]) if ignore_space else list
    shift, last_is_new = 0, False
    for n, h in enumerate(hunks, 1):
        if len(h["before"]) != h["old"] or len(h["after"]) != h["new"]:
            return False, original, f"hunk {n}: line counts differ from its header"
        at = nearest(view(lines), view(h["before"]), h["at"] + shift - (h["old"] > 0))
        if at is None:
            return False, original, f"hunk {n}: no match near line {h['at']}"
        last_is_new = at + h["old"] >= len(lines) and bool(h["after"])
        lines[at : at + h["old"]] = h["after"]
        shift += h["new"] - h["old"]
    out = "\n".join(lines) + ("\n" if lines and (ended or last_is_new) else "")
    return True, out.replace("\n", "\r\n") if crlf else out, "applied"


@F.pandas_udf(RESULT)
def apply_diff(original: pd.Series, diff: pd.Series) -> pd.DataFrame:
    rows = [applied(o or "", d or "") for o, d in zip(original, diff, strict=True)]
    return pd.DataFrame(rows, columns=["ok", "content", "log"])


@F.pandas_udf(RESULT)
def apply_diff_loosely(original: pd.Series, diff: pd.Series) -> pd.DataFrame:
    """White space inside lines does not count when places are looked for."""
    rows = [applied(o or "", d or "", ignore_space=True) for o, d in zip(original, diff, strict=True)]
    return pd.DataFrame(rows, columns=["ok", "content", "log"])


def changed_lines(diff: str):
    lines = F.split(F.col(diff), "\n")
    return F.size(F.filter(lines, lambda s: (s.startswith("+") & ~s.startswith("+++")) | (s.startswith("-") & ~s.startswith("---"))))


def best_of(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's candidates that pass the structural check and apply: fewest changed lines, then first."""
    checked = candidates.withColumn("shape", structure("diff", "snippet")).where("shape.parses").withColumn("result", apply_diff("original", "diff")).where("result.ok").withColumn("changed", changed_lines("diff"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("changed", "ordinal"))
    return checked.withColumn("rank", rank).where("rank = 1").select(*keys, "ordinal", "changed", F.col("result.content").alias("content"))


def gate(tests: str, types: str, requires_tests: str, requires_types: str, workflow_ok: str):
    """verified unless a required outcome is not true or the workflow did not succeed; outcomes that are not required may be unknown."""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    missing = lambda need, c: true(need) & ~true(c)
    return F.when(missing(requires_tests, tests) | missing(requires_types, types) | ~true(workflow_ok), "failed").otherwise("verified")


def strict_gate(applies: str, parses: str, scope: str, tests: str, types: str, needs_tests: str, needs_types: str, has_tests: str, has_types: str, completed: str, workflow_ok: str):
    """Whether a patch made in line is verified.

    The workflow must have been found and completed with success and the
    structure be true.  Tests and types must be true where the policy needs them
    or the repository's environment has them, and else not be false.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    fits = lambda need, has, c: F.when(true(need) | true(has), true(c)).otherwise(F.coalesce(F.col(c), F.lit(True)))
    return true(completed) & true(workflow_ok) & true(applies) & true(parses) & true(scope) & fits(needs_tests, has_tests, tests) & fits(needs_types, has_types, types)


def strict_results(tests: str, types: str, completed: str):
    """(tests_pass, typechecks, verification_mode) to record: both false where the workflow did not complete."""
    done = F.coalesce(F.col(completed), F.lit(False))
    kept = lambda c: F.when(done, F.col(c)).otherwise(False)
    return F.struct(kept(tests).alias("tests_pass"), kept(types).alias("typechecks"), F.when(done, "github_actions").otherwise("github_actions_unresponsive").alias("verification_mode"))
