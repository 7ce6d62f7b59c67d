"""Filter audit, line dedup and fill-in-middle against brute force, with odd cases."""

import collections
import hashlib
import itertools
import random
import re

import pytest

from orrery.llm import filter_audit, fim, line_dedup

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Filter audit


def fails(rows):
    """Filters that each row (id, text, part) fails."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = [j for j, u, _ in rows if (u or "") == t and j is not None and (i is None or j < i)]
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(earlier)}
        out.append({k for k, v in found.items() if v})
    return out


def audited(rows, labels):
    good, toxic = ({i for i, *x in labels if x[at] == 1 and i is not None} for at in (0, 1))
    failed, out = fails(rows), []
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, failed, strict=True) if (p or "") == part]
        share, steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone, left = [r for r in left if letter in r[1]], [r for r in left if letter not in r[1]]
                redundant = sum(letter in f for _, f in own) - len(gone)
                share[letter] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), redundant, sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter))
        out += [(*s[:-1], share[s[-1]]) for s in steps]
    return sorted(out)


def odd_documents():
    rnd = random.Random(11)
    words = [f"w{n}" for n in range(400)]
    long = [" ".join(rnd.sample(words, 210)) for _ in range(3)]
    texts = [None, "", " \x1c\x85 ", "A", "é" * 49 + "A", "é" * 50 + "A", "a b " * 150, "x #", long[0], long[0] + "\x0b", long[1] + " A" * 20, long[2] + "|", " ".join(words[:199]), " ".join(words[:200])]
    rows = [(rnd.choice([*range(25), None]), rnd.choice(texts), rnd.choice(["a", "b", "", None, "é"])) for _ in range(120)]
    return rows + rows[:6] + [(3, long[0], "a"), (3, long[0], "b"), (None, long[0], "a"), (7, "B" * 300_000, "a")]


def test_audit_equals_brute_force(spark):
    rows = odd_documents()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 25, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS + ", part string, mask int").repartition(3)
    docs = spark.createDataFrame(docs.collect(), docs.schema)  # rows in one order whenever read
    known = spark.createDataFrame(labels, LABELS)
    want = audited(rows, labels)
    for held in (filter_audit.HELD_BYTES, 100):
        assert sorted(map(tuple, filter_audit.audit(docs, known, held_bytes=held).collect())) == want


def test_fingerprints_that_collide(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    for digest in (filter_audit.fingerprint, lambda raw: b"0" * 16):
        got = collections.Counter()
        for r in filter_audit.masks(docs, digest=digest, held_bytes=1000).collect():
            got[r.doc_id, r.part, r["mask"]] += r.n
        bits = lambda f: sum(1 << "ABCDE".index(x) for x in f)
        assert got == collections.Counter((i, p or "", bits(f)) for (i, _, p), f in zip(rows, fails(rows), strict=True))


def test_audit_of_nothing_and_of_other_filters(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    docs = spark.createDataFrame([("a", "x", "s"), ("b", "x", "s"), ("c", "yy", "s")], "id string, text string, source string").withColumnRenamed("id", "doc_id")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    got = filter_audit.audit(docs, labels, filters={"L": lambda raw: len(raw) < 2}).collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in got} == {("LE", 1, 1, 2, 0, 1, 3), ("LE", 2, 1, 0, 1, 0, 1), ("EL", 1, 2, 1, 0, 1, 1), ("EL", 2, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError, match="distinct"):
        filter_audit.audit(docs, labels, filters={"E": filter_audit.short})


def test_copies_leave_a_task_once():
    """A task sends one row with text for each text it has read, whatever the number of copies."""
    send = filter_audit.routed(filter_audit.FILTERS, 1 << 20, filter_audit.fingerprint)
    out = list(send(0, iter([(i, "s", "same" * 50) for i in range(1000)] + [(i, "s", f"own {i}") for i in range(10)])))
    assert sum(row[1][3] is not None for row in out) == 11
    assert len({key for key, row in out if row[3] is None}) == 999


# Line dedup


def lowered(line):
    return line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})


def lines_left(rows):
    first, last = {}, lambda i: (i is None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lowered(line)
            first[key] = min(first.get(key, i), i, key=last)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(lowered(x)) < 10 or first[lowered(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return collections.Counter(out)


def line_documents():
    rnd = random.Random(12)
    some = ["", "short", "a line of ten", "A Line Of Ten", "\x0b a line of ten\r", "ÄÖÜ äöü ÄÖÜ", "äöü ÄÖÜ äöü", "K" * 10, "k" * 10, "K" * 10, "123456789", "1234567890", "\x1c234567890", "i̇" * 5, "İ" * 10, " " * 10]
    rows = [(rnd.choice([*range(12), None]), "\n".join(rnd.choice([*some, f"own line {rnd.random()}"]) for _ in range(rnd.randint(1, 12)))) for _ in range(80)]
    return rows + rows[:5] + [(5, None), (6, ""), (None, None), (2, "\n"), (3, "a line of ten\n" * 20_000 + "end"), (4, ("own words " * 20_000) + "\n" + "a line of ten")]


def test_lines_equal_brute_force(spark):
    rows = line_documents()
    want = lines_left(rows)
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, n_lines string").repartition(3)
    for share in (None, 5, 1000):  # which keys count as hot changes the route only
        out = line_dedup.deduplicated(docs, share=share)
        assert out.columns == ["doc_id", "text", "n_lines", "_n_lines", "n_dropped"]
        got = out.collect()
        assert {r.n_lines for r in got} == {"kept"}
        assert collections.Counter((r.doc_id, r.text, r._n_lines, r.n_dropped) for r in got) == want
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_hot_lines_are_found_and_stay_where_they_are(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('the same line\nown line number ', id) as text")
    lines = line_dedup.lines_of(line_dedup.identified(docs))
    hot = line_dedup.hot_hashes(lines, 16)
    assert len(hot) == 1
    later = line_dedup.later_lines(lines)
    assert later.count() == 3999 and later.where("at <> 0 or doc_id = 0").count() == 0
    # The shuffle of the other lines has no key with more than one row.
    assert lines.where(~lines.h1.isin(hot)).groupBy("h1").count().where("count > 1").count() == 0


def test_lines_without_python(spark):
    docs = spark.createDataFrame(line_documents(), "doc_id long, text string")
    plan = line_dedup.deduplicated(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    # One range partitioning serves the window, no exchange between them.
    inner = line_dedup.later_lines(line_dedup.lines_of(line_dedup.identified(docs)))._jdf.queryExecution().executedPlan().toString()
    assert inner.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in inner.split("Exchange rangepartitioning")[0]


def test_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(1, "first line\nother line"), (2, "first line\nother line\nmy own line\nfirst line\nx"), (3, "mine alone")], "doc_id long, text string")
    got = line_dedup.keep_bitmaps(line_dedup.identified(docs)).collect()
    assert [(r.doc_id, r.first, r.last) for r in got] == [(2, [0, 3], [1, 3])]


# Fill-in-middle


def fim_rows():
    rnd = random.Random(13)
    texts = [None, "", "a", "é\U0001f600 x", "<P>", "a<S", "<<<P", "M>x<", "a\nb\r\n", "\x00\x0b", "z" * 200_000 + "ö" * 70_000, "has <M> inside", "é" * 5]
    return [(rnd.choice([*range(300), None]), rnd.choice(texts)) for _ in range(400)] + [(-5, "abc"), (-5, "abc")]


def test_fim_equals_brute_force(spark):
    rows = fim_rows()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, extra int").repartition(3)
    out = fim.transformed(docs, keep=("doc_id", "text", "extra"))
    assert out.columns == ["doc_id", "text", "extra", *fim.RESULT]
    got, forms = out.collect(), collections.Counter()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    for r in got:
        text = r.text or ""
        digest = sha(f"1:{'' if r.doc_id is None else r.doc_id}")
        h = [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want = ("plain", None, None, text)
        elif h[3] % 100 < 20:
            want = ("spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
        else:
            want = ("psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (len(text), *want)
        assert (r.output_sha256, r.restored_sha256, r.extra) == (sha(want[3]), sha(text), 7)
        assert fim.rebuilt(r.output, r.form) == text
        forms[r.form] += 1
    assert min(forms.values()) > 10 and len(forms) == 3


def test_marks_cut_in_two():
    """No cut puts a mark together that is not there."""
    for text in ("<S", "<<S>"[:3], "S>", "<M", "<P<S<M", ">P>S>M>"):
        for a, b in itertools.combinations_with_replacement(range(len(text) + 1), 2):
            p, m, s = text[:a], text[a:b], text[b:]
            assert fim.rebuilt(f"<P>{p}<S>{s}<M>{m}", "psm") == text == fim.rebuilt(f"<S>{s}<P>{p}<M>{m}", "spm")


def test_units_stream():
    text = "ab  cd\n" * 30_000
    for unit in (fim.CODE_POINT, r"\S+", r"[^\n]*\n"):
        ends = [m.end() for m in re.finditer(unit, text)]
        assert fim.counted(text, unit) == len(ends)
        for ranks in ((0, 0), (0, len(ends)), (1, 65_536 % len(ends)), (len(ends) // 2, len(ends) // 2), (65_536 % len(ends), 65_537 % len(ends)), (len(ends), len(ends))):
            assert fim.cuts(text, tuple(sorted(ranks)), unit) == [ends[r - 1] if r else 0 for r in sorted(ranks)]
    assert next(fim.matches("x" * (fim.BLOCK * 1000))) == (fim.BLOCK, fim.BLOCK)  # lazy: the first block only


def test_fim_refuses(spark):
    docs = spark.createDataFrame([(1, "a", "f")], "doc_id long, text string, form string")
    with pytest.raises(ValueError, match="result columns"):
        fim.transformed(docs, keep=("doc_id", "form"))
    with pytest.raises(ValueError, match="empty"):
        fim.transformed(docs, unit="x*")
    assert fim.transformed(docs.limit(0)).count() == 0
    words = fim.transformed(docs, keep=(), unit=r"\S+").first()
    assert words.n == 1
