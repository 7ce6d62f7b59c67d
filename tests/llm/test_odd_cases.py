"""Odd cases that every text operator has a stated result for: repeated ids, clashing columns, made-up collisions, very long texts."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from orrery.llm import bpe, decontaminate, kernels, near_dedup, pii, quality, queries, sharding, substring_dedup, suffix_dedup

BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
#: Names that operators give to columns of results, or have inside.
NAMES = [
    "n_words", "score", "kept", "features", "base_failed", "n_hit", "n_items", "items_sha256", "contaminated", "hit_words", "candidates", "_candidates", "spans", "shard", "slot", "hash",
    "id", "_id", "tag", "row", "places", "start", "end", "component_id", "n_shingles", "signature", "key", "n_tokens", "ids", "_extra0", "_extra3", "_row", "_quality",
]


def left_over(rows, length=suffix_dedup.LENGTH):
    """Brute force of what the byte dedup leaves: (id, text) rows, in any order."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for k in range(len(t) - length + 1 if i is not None else 0):
            s = t[k : k + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1 if i is not None else 0):
            if least[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out.append((i, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return collections.Counter(out)


def test_repeated_ids_with_other_texts(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 999)) for _ in range(n)) + "."
    shared = " ".join(say(6) for _ in range(8))
    rows = [(1, shared), (4, shared), (4, "z" * 3000), (4, say(20) + shared[:200]), (5, "z" * 90), (5, None), (6, say(30)), (6, ""), (None, shared), (7, say(9) + "z" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.deduplicated(df, text=True).collect()
    assert collections.Counter((r.doc_id, r.kept) for r in got) == left_over(rows)
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in got)
    out = substring_dedup.deduplicated(df).collect()
    assert len(out) == len(rows)
    left = collections.Counter((r.doc_id, r.text) for r in out)
    assert left[1, shared] == 1 and left[4, "z" * 3000] == 1 and left[None, shared] == 1 and left[4, shared] == 0
    judged = quality.judged(df, spark.createDataFrame([], LABELS)).collect()
    assert collections.Counter((r.doc_id, r.n_words) for r in judged) == collections.Counter((i, len((t or "").split())) for i, t in rows)
    leaks = spark.createDataFrame([(1, shared)], BENCH)
    for limit in (0, 500_000):
        hits = collections.Counter((r.doc_id, r.contaminated) for r in decontaminate.decontaminate(df, leaks, broadcast_limit=limit).collect())
        assert hits == collections.Counter((i, (t or "").startswith(shared) or shared[:200] in (t or "")) for i, t in rows)


def test_other_ids_than_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for operator in (substring_dedup, suffix_dedup):
        with pytest.raises(TypeError):
            operator.deduplicated(df)
    assert near_dedup.classes(df).first().component_id == "a"


def test_columns_of_any_name_are_kept(spark):
    text = " ".join(f"word{i}" for i in range(90)) + " mail a.b@example.com"
    rows = [(i, text if i else "short", *(f"{c}{i}" for c in NAMES)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in NAMES))
    labels, bench = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS), spark.createDataFrame([(1, "not in there " * 5)], BENCH)
    for out, ids in (
        (quality.kept_documents(df, labels), {1, 2}), (decontaminate.clean_documents(df, bench), {0, 1, 2}), (decontaminate.clean_documents(df, bench, broadcast_limit=0), {0, 1, 2}),
        (near_dedup.deduplicated(df), {0, 1}),
    ):
        assert out.columns == df.columns
        assert {tuple(r) for r in out.collect()} == {r for r in rows if r[0] in ids}
    out = pii.redacted(df)
    assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {r[2:] for r in rows}
    assert collections.Counter(tuple(r)[: len(df.columns)] for r in sharding.sharded(df, 2).collect()) == collections.Counter(rows)
    for run in (substring_dedup.deduplicated, suffix_dedup.deduplicated, near_dedup.classes, pii.reported, lambda d: bpe.tokenized(d, queries.tokenizer_path())):
        assert {r.doc_id for r in run(df).collect()} == {0, 1, 2}


def alternating(n):
    """The Thue-Morse word and its complement: polynomial hashes modulo a power of two do not tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_made_up_collisions(spark):
    x, y = alternating(2048)
    start, end = np.array([0, 2049]), np.array([2048, 4097])
    data = np.frombuffer(f"{x} {y}".encode(), np.uint8)
    assert len(set(kernels.item_hashes(data, start, end).tolist())) == 2
    docs = spark.createDataFrame([(1, f"{x}\n{y}\n{x}"), (2, " ".join([x] * 12)), (3, " ".join([y] * 12))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judged(docs, spark.createDataFrame([], LABELS)).collect()}
    assert got[1].n_dup_lines == 1
    assert not decontaminate.decontaminate(docs.where("doc_id = 3"), spark.createDataFrame([(1, " ".join([x] * 12))], BENCH)).first().contaminated
    assert {r.component_id for r in near_dedup.classes(docs).collect()} == {1, 2, 3}


def test_spans_are_told_apart_by_bytes():
    """Equal hashes of unequal stretches remove nothing, and leave both for the sort."""
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    same, more, ids, begin = np.zeros(3, np.uint64), np.full(3, 10), np.array([1, 2, 3]), np.array([0, 60, 120])
    whole, open_ = suffix_dedup.resolved(same, same, more, ids, data, begin)
    assert whole.tolist() == [False, False, True] and open_.tolist() == [True, True, False]


def test_hot_anchors(spark, monkeypatch):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(130))
    rows = [(i, "".join(rnd.choice("klmno") for _ in range(rnd.randint(0, 12))) + passage[rnd.randint(0, 9) :] + str(i)) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.kept) for r in suffix_dedup.deduplicated(df, text=True).collect()) == left_over(rows)


def test_very_long_texts(spark):
    rnd = np.random.default_rng(1)
    word = rnd.integers(97, 123, 3 << 20).astype(np.uint8).tobytes().decode()
    many = " ".join(f"w{x}" for x in rnd.integers(0, 5000, 300_000).tolist()) + ". The end.\n"
    df = spark.createDataFrame([(1, word), (2, many), (3, many + "more"), (4, word)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judged(df, spark.createDataFrame([], LABELS)).collect()}
    assert got[1].word_chars == len(word) and got[2].n_words == 300_002
    assert {r.doc_id: r.component_id for r in near_dedup.classes(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}
    assert {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.deduplicated(df).collect()} == {1: len(word), 2: len(many), 3: 4, 4: 0}
    assert {r.doc_id for r in substring_dedup.deduplicated(df).where("n_removed = 0").collect()} == {1, 2}
    leaks = decontaminate.decontaminate(df, spark.createDataFrame([(1, many[-200:])], BENCH))
    assert {r.doc_id for r in leaks.where("contaminated").collect()} == {2, 3}
    assert pii.reported(df).where("spans = ''").count() == 4
    assert sharding.write_shards is not None and sharding.sharded(df, 2).count() == 4


def test_reliabilities_of_known_labelers():
    """Votes drawn with known error rates: the estimate finds the classes and which labelers to trust."""
    rnd = np.random.default_rng(2)
    truth = rnd.random(20_000) < 0.3
    right = [0.95, 0.9, 0.8, 0.75, 0.6, 0.55]
    votes = np.stack([np.where(rnd.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    votes[rnd.random(votes.shape) < 0.2] = 0
    counts = collections.Counter(map(tuple, votes.tolist()))
    post = pii.reliabilities(counts)
    found = np.array([post[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (found == truth).mean() > 0.95
    majority = votes.sum(1) > 0
    assert (found == truth).mean() > (majority == truth).mean() + 0.01


def test_planted_spans_by_kind(spark):
    """Precision and recall of each kind on texts with planted spans and look-alikes."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    make = {
        "email": lambda: f"{word()} (at) {word()} (dot) com", "phone": lambda: f"({rnd.randint(200, 989)}) {rnd.randint(200, 989)}-{digits(4)}",
        "secret": lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40)), "iban": iban, "ssn": lambda: f"{rnd.randint(100, 600)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}",
        "address": lambda: f"{rnd.randint(1, 99)} {word().capitalize()} Street", "person": lambda: f"{rnd.choice(sorted(pii.GIVEN))} {word().capitalize()}",
    }
    cue = {"email": "mail ", "phone": "call ", "secret": 'token = "', "iban": "iban: ", "ssn": "ssn: ", "address": "address: ", "person": "name: "}
    rows, planted = [], collections.defaultdict(set)
    for i in range(700):
        kind = list(make)[i % 7]
        span = make[kind]()
        before = " ".join(word() for _ in range(8)) + " " + cue[kind]
        rows.append((i, before + span + ('"' if kind == "secret" else "") + " " + word()))
        planted[kind].add((i, len(before), len(before) + len(span)))
    rows += [(1000 + i, f"{word()} isbn {digits(3)}-{digits(10)} commit {'a' * 30}{digits(2)} order {rnd.randint(900, 999)}-00-{digits(4)} {word()}") for i in range(300)]
    rows += [(2000 + i, f"mail {word()}@{word()}.com or +1 (743) 555-{digits(4)} {word()}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in pii.reported(df).collect():
        for kind, a, b in (x.split(":") for x in r.spans.split(",") if x):
            if r.doc_id < 2000:
                got[kind].add((r.doc_id, int(a), int(b)))
    for kind, want in planted.items():
        caught = len(want & got[kind]) / len(want)
        assert caught >= 0.9, (kind, caught)
        assert len(want & got[kind]) >= 0.9 * len(got[kind]), kind


def test_pipeline_on_odd_documents(spark, tmp_path):
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * 2 + str(rnd.randint(0, 9999)) for _ in range(n))
    good, leak = say(120), say(30)
    rows = [(1, good), (2, good), (3, good + " mail x.y@example.com"), (4, say(80) + " " + leak), (5, None), (6, ""), (None, say(70)), (None, None), (7, say(200_000)), (8, say(90)), (8, say(95))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, n_words string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    out = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == {1: 1, None: 1, 7: 1, 8: 2}
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_verdict_by_brute_force(spark):
    """The verdict again, tree by tree and row by row in plain Python."""
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judged(docs, labels).collect()
    quality_of = {}
    for r in labels.collect():
        quality_of[r.doc_id] = min(r.quality, quality_of.get(r.doc_id, r.quality))
    batch = pa.record_batch([pa.array([r.text for r in docs.collect()])], names=["text"])
    ids = [r.doc_id for r in docs.collect()]
    features = np.stack(quality.statistics(batch, 0)[1], axis=1).astype(np.float32).astype(float)
    failed = {r.doc_id: r.base_failed for r in rows}
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    good = sorted((i for i in range(len(ids)) if quality_of.get(ids[i], 0) > 0 and not failed[ids[i]]), key=lambda i: order[ids[i]])
    forest = quality.grow(features[good])

    def path(row):
        total = 0.0
        row = np.minimum(np.abs(row - forest.center) / forest.spread, quality.FARTHEST)
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + int(row[forest.feature[node]] >= forest.split[node])
            total += forest.length[node]
        return 2.0 ** (-total / len(forest.roots) / forest.norm)

    score = {i: path(f) for i, f in zip(ids, features, strict=True)}
    bins = collections.defaultdict(lambda: [0, 0])
    for i, q in quality_of.items():
        if i in score and not failed[i]:
            bins[int(score[i] * quality.BINS)][0 if q > 0 else 1] += 1
    n_good, n_bad = (max(sum(b[k] for b in bins.values()), 1) for k in (0, 1))
    best = max(range(quality.BINS + 2), key=lambda b: (lambda lost, caught: (caught - lost if lost <= quality.FALSE_REJECTS else -1, b))(sum(v[0] for k, v in bins.items() if k >= b) / n_good, sum(v[1] for k, v in bins.items() if k >= b) / n_bad))
    assert {r.doc_id: r.kept for r in rows} == {i: not failed[i] and score[i] < best / quality.BINS for i in ids}
