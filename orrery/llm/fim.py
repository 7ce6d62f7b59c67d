"""Fill-in-middle: every text is cut at two units and its parts are reordered behind marks.

A streaming matcher walks over a text twice in constant memory.  The first pass counts the
units.  Two ranks are drawn from a hash of seed and id, and the second pass advances a lazy
iterator of matches to the lower and then to the higher one.  No list of units is ever held:
code points are matched in blocks of at most ``BLOCK``, other units one by one.

A text is left plain where it is empty, holds one of the marks, or the draw says so; so the
marks in an output are the ones put there, and ``rebuilt`` gives the text back exactly.

Nulls: a null text is the empty one; a null id draws like an empty string of digits.  Repeated
rows are cut alike, each on its own; rows that share an id share the draws, taken modulo
their own lengths.  A very long text is matched block by block.  What lies between units (with
units other than code points) stays with the part after it, and behind the last cut with the
suffix.  An empty table gives no rows.  Kept columns of other names pass through; one named
as a result column is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_arrow

CODE_POINT, BLOCK = r"(?s:.)", 1 << 16
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")


def matches(text: str, unit: str = CODE_POINT) -> Iterator[tuple[int, int]]:
    """End and number of units of successive matches, lazily; several units in one match are one character each."""
    if unit == CODE_POINT:
        for match in re.finditer(f"(?s:.{{1,{BLOCK}}})", text):
            yield match.end(), match.end() - match.start()
    else:
        for match in re.finditer(unit, text):
            yield match.end(), 1


def counted(text: str, unit: str = CODE_POINT) -> int:
    return sum(units for _, units in matches(text, unit))


def cuts(text: str, ranks: tuple[int, ...], unit: str = CODE_POINT) -> list[int]:
    """Where the units of the given ascending ranks end (rank 0: at the start)."""
    found, end, passed, stream = [], 0, 0, matches(text, unit)
    for rank in ranks:
        while passed < rank:
            end, units = next(stream)
            passed += units
        found.append(end - (passed - rank))
    return found


def drawn(seed: str, doc_id: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12)]


def arranged(text: str, doc_id: object, seed: str = "1", unit: str = CODE_POINT, plain: int = 10, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the output of one text."""
    n = counted(text, unit)
    h1, h2, h3, h4 = drawn(seed, doc_id)
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = cuts(text, tuple(sorted((h1 % (n + 1), h2 % (n + 1)))), unit)
    if h4 % 100 < spm:
        form, parts = "spm", (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])
    else:
        form, parts = "psm", (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
    return n, form, a, b - a, "".join(parts)


def rebuilt(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    second, third = (SUFFIX if form == "psm" else PREFIX), MIDDLE
    head, rest = output[len(PREFIX) :].split(second, 1)
    other, middle = rest.split(third, 1)
    return head + middle + other if form == "psm" else other + middle + head


def transformed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: str = "1", unit: str = CODE_POINT, plain: int = 10, spm: int = 20, outputs: bool = True) -> DataFrame:
    """The kept columns with length in units, form, cuts in characters, digests of output and of the text rebuilt from it, and (unless ``outputs`` is false) the output.

    ``plain`` percent of the texts stay as they are, ``spm`` percent of the others put the
    suffix first.  ``unit`` is a regular expression that does not match the empty string.
    """
    if re.fullmatch(unit, ""):
        raise ValueError("a unit must not match the empty string")
    results = RESULT if outputs else RESULT[:-1]
    if clash := {c.lower() for c in keep} & set(results):
        raise ValueError(f"kept columns named as result columns: {sorted(clash)}")
    columns = list(dict.fromkeys([*keep, "doc_id", "text"]))
    ids, texts, kept = columns.index("doc_id"), columns.index("text"), [columns.index(c) for c in keep]
    types = ("long", "string", "long", "long", "string", "string", "string")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in zip(results, types, strict=False)])
    arrow = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches):
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(ids), batch.column(texts), strict=True):
                n, form, first, second, output = arranged(value.as_py() or "", doc_id.as_py(), seed, unit, plain, spm)
                rows.append((n, form, first, second, sha(output), sha(rebuilt(output, form)), output))
            made = zip(*rows, strict=True) if rows else ((),) * len(RESULT)
            new = [pa.array(list(values), kind) for values, kind in zip(made, arrow, strict=True)][: len(results)]
            yield pa.record_batch([batch.column(at) for at in kept] + new, names=[*keep, *results])

    return by_arrow(docs.select(*columns), run, schema)
