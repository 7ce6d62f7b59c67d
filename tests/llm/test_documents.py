"""The document operators against brute force on small tables with every odd case."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import bpe, decontaminate, near_dedup, pii, quality, queries, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, tree int"
BENCH = "item_id long, text string"


def words_of(rnd, n):
    return [rnd.choice("alpha beta gamma delta omega sigma kappa theta lambda rho".split()) + str(rnd.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = " ".join(words_of(rnd, 120))
    out = ["", None, " \n\t ", "one", "two words", base, base, base.upper(), "x" * 5000, "a b " * 400, "é中😀 ñ\x00 z " * 20, "line\nline\nline\n\nline"]
    for _ in range(8):
        w = base.split()
        for _ in range(rnd.randint(1, 12)):
            w[rnd.randrange(len(w))] = "new" + str(rnd.randint(0, 99))
        out.append(" ".join(w))
    passage = ". ".join(" ".join(words_of(rnd, rnd.randint(2, 14))).capitalize() for _ in range(9)) + "."
    for _ in range(6):
        out.append(" ".join(words_of(rnd, rnd.randint(5, 40))) + ". " + passage + " " + " ".join(words_of(rnd, rnd.randint(0, 30))))
    for _ in range(12):
        out.append(" ".join(words_of(rnd, rnd.randint(30, 90))) + "\n" + " ".join(words_of(rnd, 20)))
    out += ["mail bob.x@mail5.example.com or +1 (743) 555-3824, card 4485 2758 0033 4929 ip 10.2.3.255 and 1.2.3.999", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" a@b@c.d x@y..z ++ +12'] * 2
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k", 1) for i, t in texts.items()], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_is_the_library(spark, docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    got = by_id(bpe.tokenized(docs, path))
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_transducer_lookahead_and_special_tokens():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    t = tokenizers.Tokenizer.from_file(path)
    encoder, decoder = bpe.tokenizer(path)
    assert 0 < encoder.merges.lookahead < 1000
    rnd = random.Random(3)
    for alphabet in ("a", "ab", "theinrof", "=-_", "0123", "é中"):
        for n in (1, 63, 700, 20_000):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            machine = bpe.Transducer(encoder.merges, block=16)
            ids = machine.feed(text.encode()) + machine.finish()
            if alphabet != "0123" or n < 700:
                assert ids == t.encode(text, add_special_tokens=False).ids
    for text in ("a<|endoftext|>b <|endoftext|>", "it's we'll 's ''s 'really", " \n\n x\t \u2003y  ", "z" * 200_000, "w " * 90_000):
        ids = np.frombuffer(b"".join(encoder.blocks(text)), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids
        assert "".join(decoder.blocks(encoder.blocks(text))) == text
    assert "".join(decoder.blocks(iter([np.array([decoder.length.argmin(), 10, 200, 201], "<u4").tobytes()])))


def test_improper_merges_are_refused(tmp_path):
    import json

    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": [["ab", "a"], ["a", "b"]]}}))
    with pytest.raises(ValueError):
        bpe.Merges(str(path))


LOW = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_LIMIT, 0])
def test_decontamination(spark, docs, texts, limit):
    items = [(0, texts[5][30:400]), (1, "one"), (2, None), (3, "!!"), (4, " ".join(WORD.findall(texts[20].lower())[3:12])), (10, texts[21]), (11, "never seen here"), (0, texts[5][30:400])]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(i)
    got = by_id(decontaminate.decontaminate(docs, spark.createDataFrame(items, BENCH), broadcast_limit=limit))
    hits = 0
    for i, t in texts.items():
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        r, ids = got[i], sorted(map(str, found))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.hit_words) == (len(w), len(hit), len(ids), bool(hit), sorted(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        hits += bool(hit)
    assert hits > 5


def test_quality_statistics_and_verdict(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i in texts] + [(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.judged(docs, labels))
    space = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in texts.items():
        t = t or ""
        w, lines = space.findall(t), [x for x in t.split("\n") if space.search(x)]
        count = collections.Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
        again = {b for a in range(len(w) - 2) if count[tuple(w[a : a + 3])] > 1 for b in (a, a + 1, a + 2)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    nothing = by_id(quality.judged(docs, labels.limit(0)))
    assert all(r.kept == (not r.base_failed) and r.score is None for r in nothing.values())


def test_held_out_accuracy():
    """Limits calibrated on one half of the labelled rows hold on the other."""
    pq = pytest.importorskip("pyarrow.parquet")
    from orrery.llm.kernels import slices

    folder = "/root/testdata/sf0.1"
    marks = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    marks = dict(zip(marks["doc_id"], marks["quality"], strict=True))
    rows, marked = [], []
    for part in slices(iter(pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_batches())):
        stats, features = quality.statistics(part, 1)
        keep = [n for n, i in enumerate(part.column(0).to_pylist()) if i in marks and stats[0][n] >= 50 and 100 * stats[4][n] <= 50 * stats[0][n]]
        rows.append(np.stack(features, 1)[keep])
        marked += [marks[part.column(0)[n].as_py()] for n in keep]
    rows, good = np.concatenate(rows), np.array(marked) > 0
    train = np.random.default_rng(1).random(len(good)) < 0.5
    forest = quality.grow(rows[train & good])
    score = forest.score(rows)
    bins = np.floor(score * quality.BINS).astype(int)
    histogram = [(int(b), int((bins[train & good] == b).sum()), int((bins[train & ~good] == b).sum())) for b in np.unique(bins[train])]
    limit = quality.limit_from(histogram)
    assert (score[~train & good] >= limit).mean() <= 0.02
    assert (score[~train & ~good] >= limit).mean() >= 0.9


def test_forest_separates_and_limits():
    rng = np.random.default_rng(0)
    good, odd = rng.normal(0, 1, (2000, 4)), rng.normal(0, 1, (50, 4)) + 7
    forest = quality.grow(good)
    assert forest.score(odd).min() > np.quantile(forest.score(good), 0.99)
    histogram = [(300, 990, 5), (500, 6, 10), (700, 4, 85)]
    assert 0.3 < quality.limit_from(histogram) <= 0.5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def test_pii_base_spans(spark, docs, texts):
    got = by_id(pii.reported(docs))
    for i, t in texts.items():
        spans = base(t or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert set(f"{a}:{b}:{c}" for a, b, c in spans) <= set((r.spans or "").split(",")) | {""}
    assert any("secret:" in r.spans for r in got.values())


def test_pii_random_bases_match():
    rnd = random.Random(8)
    for _ in range(3000):
        t = "".join(rnd.choice("ab1250@.-+ ()%_é") for _ in range(rnd.randint(0, 40)))
        assert sorted(pii.base_spans(t)[0]) == sorted(base(t)), t


def test_long_secrets_are_masked(spark):
    """A key of any length is a candidate."""
    rnd = random.Random(9)
    keys = {i: "".join(rnd.choice("0123456789abcdefABCDEFghijKLMN") for _ in range(n)) for i, n in enumerate([40, 128, 129, 300, 5000])}
    df = spark.createDataFrame([(i, f'the api key is token = "{k}" here', "en", "s", 1, 7, "k", 1) for i, k in keys.items()], SCHEMA)
    got = by_id(pii.redacted(df))
    assert all(k not in got[i].text for i, k in keys.items())


def test_redaction_keeps_columns_and_nulls(spark, docs):
    out = by_id(pii.redacted(docs))
    assert out[1].text is None and "[EMAIL]" in out[38].text and "example.com" not in out[38].text
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text is not None)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    k = min(k, len(w))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if k else frozenset()


def near_classes(texts, k, percent):
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, docs, texts, k, percent):
    got, want = by_id(near_dedup.classes(docs, gram=k, percent=percent)), near_classes(texts, k, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert {r.doc_id for r in near_dedup.deduplicated(docs, gram=k, percent=percent).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_near_dedup_of_a_crowd(spark, monkeypatch):
    """A group larger than a region may be: split by depth, all links kept."""
    rnd = random.Random(11)
    first = words_of(rnd, 200)
    texts = {}
    for i in range(150):
        w = list(first)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(200)] = f"n{i}x{rnd.randint(0, 9)}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(near_dedup, "CROWD", 48)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(near_dedup.classes(df, gram=3, percent=85))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == near_classes(texts, 3, 85)


def star(n, centre):
    """``n`` texts, each just similar enough to the one at ``centre`` and to no other."""
    rnd = random.Random(12)
    first = words_of(rnd, 200)
    texts = {}
    for i in range(n):
        w = list(first)
        for k in range(5):
            w[40 * k + 2 + rnd.randrange(36)] = f"n{i}x{k}"
        texts[i] = " ".join(first if i == centre else w)
    return texts


def test_near_dedup_of_a_star(spark, monkeypatch):
    """Each text of a crowd has its one link: no depth may lose it."""
    texts = star(240, 100)
    monkeypatch.setattr(near_dedup, "CROWD", 16)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(near_dedup.classes(df, gram=3, percent=85))
    want = near_classes(texts, 3, 85)
    assert {c for _, c in want.values()} == {0}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_stars_beyond_a_region(spark):
    """At the real region size, and with a centre that is not the least id."""
    texts = star(1300, 1299)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert {r.component_id for r in near_dedup.classes(df, gram=3, percent=85).collect()} == {0}


def test_orders_are_cut_by_common_prefixes(monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    rng, depth = np.random.default_rng(5), 6
    order = rng.integers(0, 3, (400, near_dedup.DEEPEST)).astype("<u2")
    order[:80] = order[0]
    order = order[np.lexsort(order.T[::-1])]
    rows = pa.table({"order": pa.array([x.tobytes() for x in order], pa.binary()), "tree": pa.array(np.full(400, 3, np.int32)), "id": pa.array(np.arange(400))})
    parts = list(near_dedup.by_run(iter(rows.to_batches(max_chunksize=7)), depth, 30))
    assert sum(x.num_rows for x, _, _ in parts) == 400
    key, level, whole, crowded = (np.concatenate(x) for x in zip(*(near_dedup.cut_regions(*x[:1], depth, *x[1:]) for x in parts), strict=True))
    of = collections.Counter(order[:, :depth].tobytes()[i * 2 * depth : (i + 1) * 2 * depth] for i in range(400))
    for i in range(400):
        name = order[i, :depth].tobytes()
        assert crowded[i] or level[i] == depth or of[name] == 1
        for j in range(i):
            assert (whole[i] == whole[j]) == (name == order[j, :depth].tobytes())
            if level[i] and key[i] == key[j]:
                assert level[i] == near_dedup.DEALT or order[i, : level[i]].tobytes() == order[j, : level[i]].tobytes()
            elif not crowded[i] and not crowded[j]:
                assert name != order[j, :depth].tobytes()


@pytest.mark.parametrize("percent", [80, 85])
def test_depth_of_whole_regions(percent):
    depth = near_dedup.whole_depth(percent)
    assert near_dedup.missed(percent / 100, depth) <= 1e-5 < near_dedup.missed(percent / 100, depth + 1)
    rng, share = np.random.default_rng(1), percent / 100
    same = rng.random((20_000, near_dedup.SIZE)) < share
    runs = np.concatenate([same, same], 1)
    apart = ~np.any([runs[:, 4 * t : 4 * t + 12].all(1) for t in range(near_dedup.TREES)], 0)
    assert apart.mean() <= 1.1 * near_dedup.missed(share, 12) + 0.005


def test_substring_dedup(spark, docs, texts):
    got = by_id(substring_dedup.deduplicated(docs))
    assert got[1].text is None and got[0].n_sentences == 0
    seen = {}
    for i in sorted(texts):
        w = (got[i].text or "").split()
        for a in range(len(w) - 49):
            assert seen.setdefault(tuple(w[a : a + 50]), i) == i
        assert got[i].kept_sha256 == hashlib.sha256((got[i].text or "").encode()).hexdigest()
    assert got[5].text == texts[5] and got[6].text == "" and got[6].n_removed == got[6].n_sentences
    # units are the same when a text stands alone: spans by brute force

    from orrery.llm.kernels import text_view

    spans, units = collections.defaultdict(list), {}
    for i, t in texts.items():
        data, at = text_view(pa.array([t], pa.string()))
        u = units[i] = substring_dedup.Units(data, at)
        w = [bytes(data[a:b]) for a, b in zip(u.words.start, u.words.end, strict=True)]
        for s, e in zip(u.span_begin.tolist(), u.span_last.tolist(), strict=True):
            assert e - s < 16
            spans[tuple(w[u.begin[s] : u.end[e]])].append((i, s, e))
    gone = collections.Counter()
    removed = collections.defaultdict(set)
    for places in spans.values():
        for i, s, e in sorted(places)[1:]:
            removed[i] |= set(range(s, e + 1))
    gone.update({i: len(x) for i, x in removed.items()})
    assert {i: r.n_removed for i, r in got.items()} == {i: gone[i] for i in texts}


def test_suffix_dedup(spark, docs, texts):
    got, first = by_id(suffix_dedup.deduplicated(docs, text=True)), {}
    total = 0
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - 49):
            if first.setdefault(b[a : a + 50], i) < i:
                gone[a : a + 50] = [True] * 50
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (not n or not gone[n - 1]) for n, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept, r.kept_sha256) == (len(b), len(b) - len(left), runs, left, hashlib.sha256(left).hexdigest())
        total += r.n_removed
    assert total > 1000


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3950, 1500)
    group = np.sort(rng.integers(0, 40, 1500))
    sorter = suffix_dedup.SuffixSort(data, 50)
    order = sorter.order(starts, group)
    keys = [(group[i], data[starts[i] : starts[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(1500))
    runs = sorter.equal_runs(starts[order], group[order])
    assert len(set(runs.tolist())) == len(set(keys))


@pytest.mark.parametrize("name", ["decontaminate", "quality", "pii", "near", "substring", "suffix", "bpe"])
def test_empty_and_null_ids(spark, name):
    run = {
        "decontaminate": lambda d: decontaminate.decontaminate(d, spark.createDataFrame([], BENCH)),
        "quality": lambda d: quality.judged(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")),
        "pii": pii.reported,
        "near": near_dedup.classes,
        "substring": substring_dedup.deduplicated,
        "suffix": suffix_dedup.deduplicated,
        "bpe": lambda d: bpe.tokenized(d, queries.tokenizer_path()),
    }[name]
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long, "en", "s", 1, 1, "k", 1), (None, None, "en", "s", 1, 1, "k", 1), (4, long, "en", "s", 1, 1, "k", 1), (4, long, "en", "s", 1, 1, "k", 1)]
    assert run(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_strings_at_the_end_of_a_passage_spread():
    """Strings that begin in a passage of all documents and end behind it go to different places, however many there are."""
    from orrery.llm import suffix_dedup as s

    rnd = random.Random(9)
    passage = bytes(rnd.randrange(97, 123) for _ in range(300))
    for n in (200, 800):
        data = np.frombuffer(b"".join(bytes(rnd.randrange(97, 123) for _ in range(80)) + passage + bytes(rnd.randrange(97, 123) for _ in range(80)) for _ in range(n)), np.uint8)
        sums = s.prefix_sums(s.BYTE_CODES[data])
        for before_end in (45, 30, 16):
            begin = np.arange(n) * 460 + 380 - before_end
            keys = s.string_keys(sums, np.zeros(n, np.uint64), begin, np.zeros(n, np.int64))
            assert np.unique(keys, return_counts=True)[1].max() <= 2
        begin = np.arange(n) * 460 + 100  # inside the passage they are equal, and meet
        assert len(np.unique(s.string_keys(sums, np.zeros(n, np.uint64), begin, np.zeros(n, np.int64)))) == 1
