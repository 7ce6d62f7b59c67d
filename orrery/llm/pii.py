"""Personal data by weak supervision.

Four base patterns (e-mail, IP address, payment card, phone number) give spans
that always stay.  Looser shapes give candidates: obfuscated addresses, national
phone numbers, secrets, bank accounts, national ids, street addresses, personal
names, and what the base checks have dropped.  For every candidate, base spans
included, six labelers vote +1, -1 or 0: the shape, a gazetteer of words before
it, a gazetteer of words that speak against it, the syntax around it, a check of
its content, and how it is set apart.  They look at different things and do
disagree.  The votes of the whole corpus are counted by pattern;
expectation-maximisation on the counts estimates each labeler's reliability per
class and each pattern's probability; a logistic span classifier is trained with
those probabilities as soft labels.  Its features are not the votes: the kind,
and shape, length, mix of characters and neighbours of a candidate.  A span that
is not a base one is added if classifier and votes agree on it.  Patterns and
features are of fixed number, so the counts that reach the driver are bounded
whatever the corpus.

Nulls: a null text counts as empty and has no spans.  Without candidates there
is nothing to train and only base spans (none) remain.  Repeated documents each
get their row.  All searches take time linear in the text: patterns start at a
run's beginning and never give back what they have taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import apart, by_arrow, written

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn", "address", "person")
BASE = KINDS[:4]

# The base patterns, in forms that do not backtrack over a run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser shapes.
MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]++(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]++)++", re.I)
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+(?![A-Za-z0-9_+/=-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
STREET = re.compile(
    r"(?<![A-Za-z0-9])[0-9]{1,5},? (?:[A-Z][a-z]++ ){1,3}?(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Square|Place)(?![A-Za-z])"
    r"|(?<![A-Za-z0-9])[0-9]{1,4},? (?:rue|avenue|boulevard|place|calle|plaza) (?:d[eu]s? )?(?:la |los )?[A-Z][^\W0-9_]++"
    r"|(?<!\w)[A-Z][a-zäöüß]{2,20}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?(?!\w)"
)
NAMES = re.compile(r"(?<![^\W_])[A-Z][^\W0-9_]++\.? [A-Z][^\W0-9_]++(?: [A-Z][^\W0-9_]++)?")

# Common given names and forms of address, in alphabetical order.
GIVEN = frozenset(
    "Ahmed Alexander Alice Andrea Andrew Anna Anne Antonio Barbara Benjamin Carlos Carmen Catherine Charles Charlotte Christian Claire Daniel David Elena Elizabeth Emily Emma Eric "
    "Fatima Francisco Frank Franz George Hannah Hans Helen Henry Isabel Jack James Jan Jean Jennifer Jessica John Jose Joseph Juan Julia Karen Karl Kevin Laura Linda Lisa Louis "
    "Lucas Lucia Manuel Margaret Maria Marie Mark Martin Mary Matthew Michael Miguel Mohammed Nancy Nicolas Olivia Omar Pablo Patricia Paul Pedro Peter Philip Pierre Rachel "
    "Richard Robert Rosa Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Steven Susan Thomas Victor Walter William Wolfgang".split()
)
TITLES = frozenset("Dr Frau Herr Madame Miss Mme Mr Mrs Ms Prof Señor Señora Sir".split())
# Words before a candidate that speak for its kind, and words that speak against any.
WORDS_BEFORE = {
    "email": re.compile(r"mail|contact|write|reach|address", re.I), "ip": re.compile(r"\bip\b|addr|host|server|client", re.I), "card": re.compile(r"card|visa|credit|pay|account", re.I),
    "phone": re.compile(r"phone|tel\b|call|mobile|cell|fax|contact", re.I), "secret": re.compile(r"token|secret|passw|api.?key|\bkey\b|auth|bearer|credential", re.I),
    "iban": re.compile(r"iban|account|bank|konto|transfer", re.I), "ssn": re.compile(r"ssn|social|security|tax", re.I),
    "address": re.compile(r"address|lives?\b|located|street|adresse|wohn|dirección", re.I), "person": re.compile(r"name|contact|author|signed|dear|from|by\b|patient|customer", re.I),
}
AGAINST = re.compile(r"version|commit|sha-?\d*|md5|hash|checksum|isbn|issn|doi|order|ticket|build|serial|figure|table|page|chapter|example|sample|dummy|chapitre", re.I)
ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
LABELERS, FEATURES = 6, 16
ROUNDS, ACCEPT, TRUST = 40, 0.9, 0.5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(divmod(2 * int(x), 10)[0] + 2 * int(x) % 10 for x in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans: at each @, the run of local characters before it that no earlier span has taken."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text, begin - 1, begin):
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans by the base patterns and, apart, the matches that their checks drop."""
    good, bad = [("email", *x) for x in emails(text)] if "@" in text else [], []
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            parts = (p.lstrip("0") for p in m[0].split("."))
            (good if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts) else bad).append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19:
                (good if luhn(digits) else bad).append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                (good if 8 <= sum(map(str.isdigit, m[0])) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def loose_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if any(c in text for c in "([{"):
        for m in MASKED.finditer(text):
            yield "email", *m.span()
    for m in NATIONAL.finditer(text):
        yield "phone", *m.span()
    for m in SECRET.finditer(text):
        word = m[0]
        if any(map(str.isdigit, word)) and any(map(str.isalpha, word)):
            yield "secret", *m.span()
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("address", STREET)):
        for m in pattern.finditer(text):
            yield kind, *m.span()
    for m in NAMES.finditer(text):
        first = m[0].split(" ", 1)[0].rstrip(".")
        if first in GIVEN or first in TITLES:
            yield "person", *m.span()


def _mixed(word: str) -> bool:
    """Many different characters, digits and letters in turns."""
    return len(set(word)) >= 8 and sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:], strict=False)) >= 4


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def content(kind: str, word: str, base: bool, dropped: bool) -> int:
    """What a check of the candidate's own characters says."""
    digits = [c for c in word if "0" <= c <= "9"]
    if kind == "secret":
        return 1 if _mixed(word) else -1
    if kind == "iban":
        return 1 if mod97(word.replace(" ", "")) else -1
    if kind == "ssn":
        return -1 if word[:3] in ("000", "666") or word[0] == "9" or word[4:6] == "00" or word[7:] == "0000" else 1
    if kind == "card":
        return -1 if dropped or len(set(digits)) < 3 else 1
    if kind == "phone":
        return -1 if dropped or len(set(digits)) < 3 else 1 if base else 1 if len(digits) == 10 and "1" < digits[0] and "1" < digits[3] else -1
    if kind == "ip":
        return -1 if dropped or word in ("0.0.0.0", "127.0.0.1", "255.255.255.255") else 1
    if kind == "person":
        return 1 if word.split(" ", 1)[0] in GIVEN else 0
    return 1 if base else 0


def look(text: str, kind: str, start: int, end: int, base: bool, dropped: bool) -> tuple[list[int], list[int]]:
    """The labelers' votes and the classifier's features of one candidate."""
    before, after, word = text[max(0, start - 32) : start], text[end : end + 2], text[start:end]
    named, against, assigned = bool(WORDS_BEFORE[kind].search(before)), bool(AGAINST.search(before)), bool(ASSIGNED.search(before))
    quoted = before[-1:] in tuple("\"'`") and after[:1] == before[-1:]
    apart = not (before[-1:].isalnum() or after[:1].isalnum())
    votes = [
        1 if base else -1 if dropped else 0,  # shape
        1 if named else 0,  # gazetteer
        -1 if against else 0,  # gazetteer of the opposite
        1 if assigned or quoted else 0,  # syntax
        content(kind, word, base, dropped),
        -1 if not apart or before[-1:] in tuple("/\\#") or after[:1] in tuple("/\\") else 0,  # surroundings
    ]
    digits = sum(map(str.isdigit, word)) * 4 // len(word)
    size = sum(len(word) > n for n in (12, 20, 40))
    kinds = KINDS.index(kind)
    features = [int(base), int(dropped), *(kinds >> b & 1 for b in range(4)), digits >> 1 & 1 | digits >> 2 & 1, digits & 1, size >> 1, size & 1, int(_mixed(word)), int(" " in word), int(any(map(str.isupper, word))), int(assigned), int(quoted), int(before[-1:] in ("", " ", "\n"))]
    return votes, features


def _code(values: list[int], base: int, low: int) -> int:
    out = 0
    for v in values:
        out = out * base + v - low
    return out


def _decode(code: int, base: int, low: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        code, v = divmod(code, base)
        out.append(v + low)
    return out[::-1]


def overlap(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b in spans)


def candidates(text: str) -> list[tuple[str, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, features) of all candidates; loose ones only beside the base spans."""
    if not text:
        return []
    good, bad = base_spans(text)
    taken = [(a, b) for _, a, b in good]
    out = []
    taken.sort()
    starts = np.array([a for a, _ in taken] or [0])
    ends = np.maximum.accumulate(np.array([b for _, b in taken] or [0]))
    for kind, a, b, base, dropped in [*((*x, True, False) for x in good), *((*x, False, True) for x in bad), *((*x, False, False) for x in loose_spans(text))]:
        if not base:
            i = int(np.searchsorted(starts, b)) - 1
            if i >= 0 and ends[i] > a:
                continue
        votes, features = look(text, kind, a, b, base, dropped)
        out.append((kind, a, b, base, _code(votes, 3, -1), _code(features, 2, 0)))
    return out


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over vote patterns: P(personal | votes)."""
    patterns = sorted(counts)
    votes, n = np.array(patterns).reshape(len(patterns), -1), np.array([counts[p] for p in patterns], float)
    post = 1 / (1 + np.exp(-2.0 * votes.sum(1)))  # the majority begins
    for _ in range(rounds):
        log = []
        for side in (post, 1 - post):
            weight = n * side
            like = np.full(len(patterns), np.log((weight.sum() + 1) / (n.sum() + 2)))
            for j in range(votes.shape[1]):
                for v in (-1, 0, 1):
                    at = votes[:, j] == v
                    like[at] += np.log((weight[at].sum() + 1) / (weight.sum() + 3))
            log.append(like)
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    if (n * post * votes.sum(1)).sum() / max((n * post).sum(), 1e-9) < (n * (1 - post) * votes.sum(1)).sum() / max((n * (1 - post)).sum(), 1e-9):
        post = 1 - post  # the classes have no names: the one with more positive votes is "personal"
    return dict(zip(patterns, post.tolist(), strict=True))


def trained(rows: list[tuple[list[int], float, int]], steps: int = 400) -> np.ndarray:
    """Logistic regression on (features, soft label, count); bias last."""
    x = np.array([[*f, 1] for f, _, _ in rows], float)
    y, n = np.array([p for _, p, _ in rows]), np.array([c for _, _, c in rows], float)
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x.T * (n * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (y - p)) - 1e-4 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,votes:int,features:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())]))


def found(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with every document's candidates."""
    columns = list(dict.fromkeys([*keep, "text"]))
    text = columns.index("text")
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + f"_candidates {SPAN}"

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base", "votes", "features"), x, strict=True)) for x in candidates(value.as_py() or "")] for value in batch.column(text)]
            yield pa.record_batch([*(batch.column(columns.index(c)) for c in keep), pa.array(spans, SPAN_TYPE)], names=[*keep, "_candidates"])

    return by_arrow(docs.select(*columns), run, schema)


def taken(facts: DataFrame) -> set[tuple[int, int]]:
    """(votes, features) of the candidates to add: those that votes and classifier, both trained on all rows through counts by pattern, find personal."""
    rows = [tuple(r) for r in facts.select(F.explode("_candidates").alias("c")).groupBy("c.votes", "c.features").count().collect()]
    if not rows:
        return set()
    by_votes: dict[tuple[int, ...], int] = {}
    for v, _, n in rows:
        key = tuple(_decode(v, 3, -1, LABELERS))
        by_votes[key] = by_votes.get(key, 0) + n
    post = reliabilities(by_votes)
    rows = [(v, f, n, post[tuple(_decode(v, 3, -1, LABELERS))]) for v, f, n in rows]
    weights = trained([(_decode(f, 2, 0, FEATURES), p, n) for _, f, n, p in rows])
    score = {f: 1 / (1 + np.exp(-np.array([*_decode(f, 2, 0, FEATURES), 1], float) @ weights)) for _, f, _, _ in rows}
    return {(v, f) for v, f, _, p in rows if p >= ACCEPT and score[f] >= TRUST}


def spans_of(cells: list[dict], added: set[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and accepted ones, by kind as listed, then start."""
    return sorted(((c["kind"], c["start"], c["end"]) for c in cells if c["base"] or (c["votes"], c["features"]) in added), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _line(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def reported(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    facts = written(found(docs, (id_column,)), "pii")
    added = taken(facts)
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string"

    def run(batches):
        for batch in batches:
            cells = batch.column(1).to_pylist()
            base = [spans_of([c for c in x if c["base"]], set()) for x in cells]
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE]
            yield pa.record_batch(
                [batch.column(0), *counts, pa.array([hashlib.sha256(_line(x).encode()).hexdigest() for x in base], pa.string()), pa.array([_line(spans_of(x, added)) for x in cells], pa.string())],
                names=[id_column, *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return facts.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans merge under the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans masked in ``text`` (and ``n_chars`` counted anew, if there)."""
    inner, columns = apart(docs, "text", "n_chars")
    facts = written(found(inner, tuple(inner.columns)), "pii")
    added, names = taken(facts), inner.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            new = [None if t is None else masked(t, spans_of(c, added)) for t, c in zip(batch.column(text).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            out = [batch.column(i) for i in range(len(names))]
            out[text] = pa.array(new, pa.string())
            if chars is not None:
                out[chars] = pa.array([old.as_py() if t is None else len(t) for t, old in zip(new, out[chars], strict=True)], batch.schema.field(chars).type)
            yield pa.record_batch(out, names=names)

    return by_arrow(facts, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)).select(*columns)
