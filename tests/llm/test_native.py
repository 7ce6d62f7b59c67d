"""URL filter, sharding and chat formatting: SQL functions only, checked by plain Python."""

import collections
import hashlib
import random
import zlib

import pytest

from orrery.llm import chat, queries, sharding, url_filter


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end].translate({c: c + 32 for c in range(65, 91)}), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filter(spark):
    rnd = random.Random(2)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "xexample.com", "net", "", "com.example"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/7/x", "/en/77", "/de/\U0010ffff", "/e\u00e9/"]
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h in hosts for p in paths if rnd.random() < 0.5}.values())
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "ftp://com?/en/", "x://com:80/en/", "a://b://com/en/", "http://com/en/\nx?y"]
    urls += [f"https://{rnd.choice(['', 'www.', 'q.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '/', 'z', '?q=1', '#f'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 250, u, "h", 1, "k") for i, u in enumerate(urls)], "page_id long, url string, html string, salt int, key string")
    for target in (url_filter.TARGET, 3):
        table = spark.createDataFrame(rules + [(None, "/x", "block"), ("", "/", "block")], "host string, path string, action string")
        got = collections.Counter(tuple(r) for r in url_filter.judged(pages, table, target=target).collect())
        assert got == collections.Counter((i % 250, *judge(u, rules)) for i, u in enumerate(urls))
    empty = url_filter.judged(pages, spark.createDataFrame([], "host string, path string, action string"))
    assert {r.verdict for r in empty.collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_rules_of_the_contract(spark):
    """The query's own rules, one url for each: what fits net/de/ is allowed, what fits the longer rule below it is not."""
    want = {"http://a.com/en/": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://b.net/de/8": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://c.org/es/1": ("org/es/", "block"), "http://c.org/de/": (None, "allow")}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    got = url_filter.judged(pages, url_filter.rule_table(spark)).collect()
    assert [(r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == list(want.values())


def test_same_rule_twice_blocks(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert url_filter.judged(pages, rules).first().verdict == "block"


def inside_out(n, draw):
    order = []
    for i in range(n):
        j = draw(i)
        order.append(i)
        order[i], order[j] = order[j], i
    return order


def test_fisher_yates(spark):
    for bucket in range(4):
        for n in (0, 1, 2, 50):
            got = spark.sql(f"select {sharding.fisher_yates(str(n), str(bucket))} as p").first().p
            draws = [r[0] for r in spark.sql(f"select cast(pmod(xxhash64({sharding.SEED}, {bucket}, cast(id as int)), cast(id as int) + 1) as int) from range({n}) order by id").collect()]
            assert got == inside_out(n, lambda i, d=draws: d[i])


def test_shards_of_clashing_columns_and_null_ids(spark, tmp_path):
    data = [(None, f"t{i}", i, 2 * i, "x" * (1 << 20 if i == 3 else 1)) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard long, slot long, hash string")
    sharding.write_shards(df, str(tmp_path / "out"), 3)
    got = sharding.read_shards(df, str(tmp_path / "out")).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(data)
    assert sorted(collections.Counter(r._shard for r in got).values()) == [13, 13, 14]


@pytest.mark.parametrize("rows", [1, 7, 2048])
def test_sharding_law(spark, rows):
    data = [(i, f"text {i % 5}" if i % 7 else None, "x", 1) for i in range(300)] + [(None, "", "x", 1), (3, "text 3", "x", 1), (3, "text 3", "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard_name string, count long")
    out = sharding.sharded(sharding.digest(df), 24, bucket_rows=rows).collect()
    assert len(out) == len(data)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in data)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(24))
    again = sharding.sharded(sharding.digest(df.repartition(3)), 24, bucket_rows=rows).collect()
    key = lambda r: (r.shard, r.slot)
    assert [r["size"] for r in sorted(out, key=key)] == [r["size"] for r in sorted(again, key=key)]
    assert sharding.sharded(sharding.digest(df.limit(0)), 24).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(100).selectExpr("id as doc_id", "concat('t', id) as text")
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 100 and {r[0] for r in got.select("shard").distinct().collect()} == set(range(5))


def test_whole_documents_are_sharded(spark, tmp_path, monkeypatch):
    """The query writes the documents themselves and tells what it reads back; buckets hold a number of bytes."""
    data = [(i, "t" * 50 * (i % 9) if i % 7 else None, "en") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "scratch_dir", lambda spark: str(tmp_path))
    told = queries.op7_sharding(spark, str(tmp_path)).collect()
    (folder,) = tmp_path.glob("shards-*")
    kept = spark.read.parquet(str(folder)).collect()
    assert {(r.doc_id, r.text, r.lang) for r in kept} == set(data) and len(kept) == len(told) == 300
    place = {r.doc_id: (r.shard, r.slot, len(r.text or "") + 8, zlib.crc32((r.text or "").encode())) for r in kept}
    assert {r.doc_id: (r.shard, r.slot, r["size"], r.text_crc32) for r in told} == place
    orders = [[r.doc_id for r in sharding.sharded(df, 1, bucket_bytes=n).orderBy("slot").collect()] for n in (500, 1 << 20)]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_fold_of_events(spark):
    events = [
        (1, 5, "m2", "delta", "assistant", "lo"), (1, 4, "m2", "delta", "assistant", "hel"), (1, 1, "m1", "delta", "user", "hi"), (1, 6, "m2", "regenerate", "assistant", "new"),
        (1, 7, "m2", "delta", "assistant", "er"), (1, 8, "m1", "edit", "user", "hi there"), (1, 9, "m3", None, None, None), (None, 1, "z", "delta", "user", "q"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, message string, kind string, role string, text string")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.reconstructed(df).collect()}
    assert got == {1: [("user", "hi there"), ("assistant", "newer"), ("", "")], None: [("user", "q")]}


def test_chat_round_trip(spark):
    rnd = random.Random(6)
    pieces = ["<|turn|>", "<|end|>", "<\\|", "<\\\\|turn|>", "\\", "<", "|", "\n", "</s>", "[INST]", "é😀", "plain"]
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "a\nb\\n<|turn|>", None]), rnd.choice([None, "", "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))])))
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (None, 1, "assistant", "x"), (5, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.rendered(chat.reconstructed(chat.log_of(df)))
    strings = {r.conv_id: r.formatted for r in formatted.collect()}
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    talks = collections.defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    for c, turns in talks.items():
        turns.sort()
        said = [(r[1], x[1]) for _, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        r = got[c]
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert strings[c].count("<|turn|>") == len(said) == strings[c].count("<|end|>") and r.formatted_chars == len(strings[c])
    assert chat.read_back(chat.rendered(chat.reconstructed(chat.log_of(df.limit(0))))).count() == 0


def test_native_plans_have_no_python(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("op4_url_filter", "op7_sharding", "op8_chat"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
