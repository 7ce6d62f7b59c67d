"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, filter_audit, fim, line_dedup, near_dedup, pii, quality, sharding, substring_dedup, suffix_dedup, url_filter
from .common import scratch_dir, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed tokenizer file; a parameter, never a copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_words")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.reported(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, path, 24)
    shard, slot = sharding.placed_names(docs)
    placed = sharding.digest(sharding.read_shards(docs, path), shard, slot)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.rendered(chat.reconstructed(chat.log_of(turns))))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), gram=3, percent=85)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(table(spark, sf_dir, "documents"), outputs=False)


OP4_SQL = r"""
with u as (
  select page_id,
    case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from u),
rules(rhost, rpath, action) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (
  select page_id, host, path, rhost || rpath as rule, action,
    row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as rn
  from h left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from m where rn = 1
"""

OP8_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as body,
    length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) as head from c),
g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum(body + head + length('<|turn|>') + length('<|end|>') + 2) as formatted_chars from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from g
"""

OP11_SQL = r"""
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
m as (
  select doc_id, part, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(min(doc_id) over (partition by text) < doc_id, false)::int as mask from t),
l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
g as (
  select part, mask, count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (toxic = 1) as toxic from m left join l using (doc_id) group by part, mask),
f(name, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) r(step)),
c as (
  select part, filter_order, step::int as step, bit,
    sum(n) filter (mask & (before | bit) = 0) as kept, sum(n) filter (mask & bit <> 0 and mask & before = 0) as removed,
    sum(n) filter (mask & bit <> 0 and mask & before <> 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
    sum(good) filter (mask & bit <> 0 and mask & before = 0) as good_lost, sum(toxic) filter (mask & bit <> 0 and mask & before = 0) as toxic_lost
  from g, s group by part, filter_order, step, bit)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley from c
"""

OP12_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from d),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
j as (select *, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as dropped from k)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256 from j group by doc_id
"""

OP13_SQL = r"""
with h as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as hex from documents),
r as (
  select *, ('0x' || hex[1:8])::bigint % (n + 1) as c1, ('0x' || hex[9:16])::bigint % (n + 1) as c2,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || hex[17:24])::bigint % 100 >= 90 then 'plain'
      when ('0x' || hex[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (
  select *, substr(text, 1, least(c1, c2)) as prefix, substr(text, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) as middle, substr(text, greatest(c1, c2) + 1) as suffix from r)
select doc_id, n, form, case when form <> 'plain' then least(c1, c2) end as prefix_chars, case when form <> 'plain' then greatest(c1, c2) - least(c1, c2) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_chat": op8_chat,
    "op9_near_dedup": op9_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_fim": op13_fim,
}
ORACLES: dict[str, str] = {"op4_url_filter": OP4_SQL, "op8_chat": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_fim": OP13_SQL}
