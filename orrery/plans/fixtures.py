"""Queries of the parsers, diffs and stream operators, on texts derived from whole tables; literal examples for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import callsites, changelog, diffs, imports, text
from ..operators import scheduling
from ..sources.scratch import new_path
from ..streaming import graph_store, graph_updates, stages, stateful
from .bindings import Domain
from .queries import query

CHANGELOGS = [
    ("a", "# 2.0\n## Breaking Changes\n- renamed `openFile` to `open_file`\n- `getAll` -> `list_all`\n- the `retry` parameter order changed\n## Fixes\n- tidy"),
    ("b", "- Removed `legacy()` and oldCall()\n- dropped support for `py36`\n* deprecated `slow_path`\nplain `not_a_bullet`"),
    ("c", "breaking:\n`send` now raises\n# end\n- argument order of `mix` changed\n- removed the cache"),
]
TREE = [
    ("r", "tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}'),
    ("r", "src/app.ts", "import { a } from '@/lib/a';\nimport b from './b';\nimport c from './missing';\nimport(name);\nexport * from 'react';\n"),
    ("r", "src/lib/a.ts", "export const a = 1;\n"),
    ("r", "src/b.tsx", "const a = require('./lib/a');\n"),
    ("r", "pkg/__init__.py", "from .core import run\nimport os\n"),
    ("r", "pkg/core.py", "from . import tools\nfrom pkg import tools\n"),
    ("r", "pkg/tools.py", ""),
    ("r", "native/main.c", '#include "util.h"\n#include <stdio.h>\n'),
    ("r", "native/util.h", ""),
    ("r", "src/main.rs", "use crate::store::disk;\n"),
    ("r", "src/store/disk.rs", ""),
    ("r", "node_modules/x/index.js", "require('./y')"),
]


CHANGELOG = """if(p_partkey % 2 = 0,
    concat('# ', p_size, '.0\n## Breaking Changes\n- renamed `old', p_partkey, '` to `new', p_partkey, '`\n- the `opt', p_size, '` parameter order changed\n`send', p_partkey, '` now raises\n## Fixes\n- tidy\n- Removed `gone', p_partkey, '()` and more\nplain `no`\n* deprecated `slow', p_partkey, '`'),
    concat('- `a', p_partkey, '` -> `b', p_partkey, '`\n- dropped `a', p_partkey, '`\n- dropped `a', p_partkey, '` again\nplain `a`'))"""


@query(sql="""with p as (select p_partkey as id, p_partkey::varchar as k, p_size::varchar as z from part) select id, 0 as position, 'old' || k as symbol, 'new' || k as symbol_new, 'renamed' as change_type, '- renamed `old' || k || '` to `new' || k || '`' as description, 0.95::double as confidence from p where id % 2 = 0
    union all select id, 1, 'opt' || z, 'opt' || z, 'signature_change', '- the `opt' || z || '` parameter order changed', 0.8 from p where id % 2 = 0 union all select id, 2, 'send' || k, 'send' || k, 'behavior_change', '`send' || k || '` now raises', 0.8 from p where id % 2 = 0
    union all select id, 3, 'gone' || k, null, 'removed', '- Removed `gone' || k || '()` and more', 0.85 from p where id % 2 = 0 union all select id, 4, 'slow' || k, null, 'deprecated', '* deprecated `slow' || k || '`', 0.8 from p where id % 2 = 0
    union all select id, 0, 'a' || k, 'b' || k, 'renamed', '- `a' || k || '` -> `b' || k || '`', 0.9 from p where id % 2 = 1 union all select id, 1, 'a' || k, null, 'removed', '- dropped `a' || k || '`', 0.85 from p where id % 2 = 1""")  # fmt: skip
def changelog_changes(d: Domain) -> DataFrame:
    return changelog.changelog_changes(d.table("part").selectExpr("p_partkey as id", f"{CHANGELOG} as changelog"))


@query(sql="""with p as (select *, p_partkey::varchar as k, p_size::varchar as z from part where p_size % 5 > 0), t as (select 'p' || k || '.ts' as path, 'wire' || z as package, length('import { send } from ''wire' || z || chr(39) || ';' || chr(10) || chr(10)) as start_byte, 'send(' || k || ')' as snippet from p where p_partkey % 2 = 0
    union all select 'p' || k || '.py', 'wire' || z, length('import wire' || z || chr(10) || chr(10)), 'wire' || z || '.send(' || k || ')' from p where p_partkey % 2 = 1)
    select path, 'send' as symbol, package, 3 as line_start, 3 as line_end, start_byte::int as start_byte, (start_byte + length(snippet))::int as end_byte, snippet from t""")  # fmt: skip
def call_sites(d: Domain) -> DataFrame:
    named = "if(p_size % 5 = 0, 'other', concat('wire', p_size))"
    sources = d.table("part").selectExpr(
        "concat('p', p_partkey, if(p_partkey % 2 = 0, '.ts', '.py')) as path",
        f"if(p_partkey % 2 = 0, concat(\"import {{ send }} from '\", {named}, \"';\\n\\nsend(\", p_partkey, \");\\n// send(1)\\nconst s = 'send(2)';\\n\"), concat('import ', {named}, '\\n\\n', {named}, '.send(', p_partkey, ')\\n')) as source",
        "'send' as symbol", "concat('wire', p_size) as package", "cast(null as array<string>) as import_names",
    )
    return callsites.call_sites(sources)


SPECIFIED = "if(p_partkey % 2 = 0, concat(\"import a from './n\", p_partkey + 1, \"';\\nimport b from 'react';\\nimport(x\", p_size, \");\\n// import './no';\\n\"), concat('from .m', p_size, ' import x\\nimport os\\n'))"


@query("atlas_nodes", """with p as (select p_partkey, p_size, repo_id, 'src/n' || p_partkey || case when p_partkey % 2 = 0 then '.ts' else '.py' end as path from part join atlas_nodes on node = p_partkey)
    select repo_id, path, 'typescript' as language, './n' || (p_partkey + 1) as spec, false as is_dynamic, true as is_internal from p where p_partkey % 2 = 0 union all select repo_id, path, 'typescript', 'react', false, false from p where p_partkey % 2 = 0
    union all select repo_id, path, 'typescript', 'x' || p_size, true, false from p where p_partkey % 2 = 0 union all select repo_id, path, 'python', '.m' || p_size, false, true from p where p_partkey % 2 = 1 union all select repo_id, path, 'python', 'os', false, false from p where p_partkey % 2 = 1""")  # fmt: skip
def import_specifiers(d: Domain) -> DataFrame:
    rows = d.table("part").join(d.atlas_nodes.select("repo_id", F.col("node").alias("p_partkey")), "p_partkey")
    return imports.extracted(imports.files(rows.selectExpr("repo_id", "concat('src/n', p_partkey, if(p_partkey % 2 = 0, '.ts', '.py')) as path", f"encode({SPECIFIED}, 'UTF-8') as content")))


# Endings and import lines by a node's place in its repository; {} stands for the target.
WRITTEN_IN = (
    (".ts", "import './n{}';"), (".py", "from .n{} import x"), (".go", 'import "src/n{}"'), (".c", '#include "n{}.c"'), (".rs", "use crate::n{};"),
    (".rb", "require_relative 'n{}'"), (".php", "include 'n{}.php';"), (".js", "import '@/n{}';"),
)
PUSHED = {"added": 5, "modified": 3, "removed": 7}  # places modulo ten


def source_tree(d: Domain, kept: str = "true") -> DataFrame:
    """A file for each node, in eight languages, which imports the nodes that it links to (of these, the ones for which ``kept`` holds); a path map for each repository."""
    repos = d.table("supplier").count()
    pick = lambda at: f"element_at(array({', '.join(repr(x[at]) if chr(39) not in x[at] else chr(34) + x[at] + chr(34) for x in WRITTEN_IN)}), cast(place % {len(WRITTEN_IN)} as int) + 1)"
    rows = d.atlas_nodes.selectExpr("repo_id", "node", f"node div {repos} as place").selectExpr("*", f"{pick(0)} as ending", f"{pick(1)} as line")
    wanted = d.atlas_links.where(kept.format(place=f"src div {repos}")).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("tgt")).alias("targets"))
    lines = F.array_join(F.transform("targets", lambda t: F.replace("line", F.lit("{}"), t.cast("string"))), "\n")
    files = rows.join(wanted, "node", "left").select("repo_id", "place", F.concat(F.lit("src/n"), F.col("node").cast("string"), "ending").alias("path"), F.encode(F.coalesce(lines, F.lit("")), "UTF-8").alias("content"))
    config = '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'
    return files.unionByName(rows.select("repo_id").distinct().select("repo_id", F.lit(0).cast("long").alias("place"), F.lit("tsconfig.json").alias("path"), F.encode(F.lit(config), "UTF-8").alias("content")))


ENDINGS = "case place % 8 " + " ".join(f"when {i} then '{ending}'" for i, (ending, _) in enumerate(WRITTEN_IN)) + " end"


def imported(nodes: str = "true", links: str = "true") -> str:
    """SQL for the edges of ``source_tree`` among the nodes and links for which the conditions hold."""
    return f"""with n as (select repo_id, node, place, 'src/n' || node || {ENDINGS} as path, {ENDINGS} as ending from (select *, node // (select ns from k) as place from atlas_nodes) where {nodes}),
    l as (select distinct a.repo_id, a.path, a.ending, tgt from atlas_links join n a on a.node = src where {links}),
    direct as (select l.repo_id, l.path, b.path as target from l join n b on b.repo_id = l.repo_id and b.node = tgt
        where case when l.ending in ('.ts', '.js') then b.ending in ('.ts', '.js') when l.ending = '.rb' then b.ending in ('.c', '.rb', '.php') when l.ending = '.go' then false else b.ending = l.ending end),
    inside as (select l.repo_id, l.path, min(b.path) as target from l join n b on b.repo_id = l.repo_id and b.ending = '.go' and contains(b.path, 'src/n' || tgt) where l.ending = '.go' group by l.repo_id, l.path, tgt)
    select distinct repo_id, path as source_path, target as target_path from (select * from direct union all select * from inside) where path <> target"""


@query("k atlas_nodes atlas_links", imported())
def resolve_imports(d: Domain) -> DataFrame:
    return graph_updates.full_build(source_tree(d)).edges


@query("k atlas_nodes atlas_links", imported(f"place % 10 <> {PUSHED['removed']}", f"a.place % 10 <> {PUSHED['modified']} or tgt % 2 = 1"))
def graph_push(d: Domain) -> DataFrame:
    """A push to every repository, with new, changed and removed files, folded into a stored graph and read back."""
    store = graph_store.GraphStore(d.spark, new_path(d.spark, "graph"), parts=8)
    tree = source_tree(d)
    store.build(tree.where(F.col("place") % 10 != PUSHED["added"]).drop("place"))
    changed = source_tree(d, f"{{place}} % 10 <> {PUSHED['modified']} or tgt % 2 = 1").where((F.col("place") % 10).isin(PUSHED["added"], PUSHED["modified"]))
    store.push(changed.drop("place"), tree.where(F.col("place") % 10 == PUSHED["removed"]).select("repo_id", "path"))
    return store.graph().edges


def candidates(d: Domain) -> DataFrame:
    """Three patches for each order: one of three changed lines, two of two; some do not fit, some are none."""
    head, tail = "concat(' a', k, '\\n-b', c, '\\n')", "' c\\n'"
    long = f"concat('@@ -1,3 +1,4 @@\\n', {head}, '+B\\n+D\\n', {tail})"
    short = f"concat('@@ -1,3 +1,3 @@\\n', if(k % 3 = 0, ' a\\n-none\\n', {head}), '+B\\n', {tail})"
    other = f"if(k % 7 = 0, 'UNABLE_TO_PATCH', concat('@@ -1,3 +1,3 @@\\n', {head}, '+Z\\n', {tail}))"
    rows = d.table("orders").selectExpr("o_orderkey as k", "o_custkey as c")
    rows = rows.selectExpr("k", "concat('a', k, '\\nb', c, '\\nc\\n') as original", "if(k % 5 = 0, 'zzz', concat('  b', c)) as snippet", f"posexplode(array({long}, {short}, {other})) as (ordinal, diff)")
    return rows.selectExpr("k as usage", "ordinal", "original", "diff", "snippet")


FITS = """c as (select o_orderkey as usage, unnest([0, 1, 2]) as ordinal, o_orderkey as k, 'a' || o_orderkey as a, 'b' || o_custkey as b from orders),
    f as (select *, case when ordinal = 0 then true when ordinal = 1 then k % 3 > 0 else k % 7 > 0 end as fits, case ordinal when 0 then 3 else 2 end as changed,
    case ordinal when 0 then 'B' || chr(10) || 'D' when 1 then 'B' else 'Z' end as new from c)"""
AFTER = "a || chr(10) || {} || chr(10) || 'c' || chr(10)"


@query(sql=f"with {FITS} select usage, ordinal, fits as ok, case when fits then {AFTER.format('new')} else {AFTER.format('b')} end as content from f")
def diff_apply(d: Domain) -> DataFrame:
    return candidates(d).withColumn("r", diffs.apply_diff("original", "diff")).select("usage", "ordinal", "r.ok", "r.content")


@query(sql=f"with {FITS} select usage, ordinal, changed, content from (select usage, ordinal, changed, {AFTER.format('new')} as content, row_number() over (partition by usage order by changed, ordinal) as rn from f where fits and k % 5 > 0) where rn = 1")
def best_of_n(d: Domain) -> DataFrame:
    return diffs.best_of(candidates(d), ["usage"])


@query(sql=f"with {FITS} select usage, ordinal, not (ordinal = 2 and k % 7 = 0) as applies, k % 5 > 0 and fits as scope from f")
def patch_structure(d: Domain) -> DataFrame:
    return candidates(d).withColumn("s", diffs.structure("diff", "snippet")).select("usage", "ordinal", "s.applies", "s.scope")


@query(sql=rf"select doc_id, sha256(regexp_replace(text, '{text.KEY_PATTERN}', '[REDACTED]', 'g')) as redacted_sha256 from documents")
def redact_documents(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.sha2(text.redacted("text"), 256).alias("redacted_sha256"))


@query("atlas_nodes", r"select node, path, string_split(path, '/')[-1] as name, case when path like '%/%' then regexp_replace(path, '/[^/]*$', '') else '' end as folder, len(string_split(path, '/')) - 1 as depth, lower(regexp_extract(string_split(path, '/')[-1], '[^.](\.[^.]*)$', 1)) as ext from atlas_nodes")
def path_parts(d: Domain) -> DataFrame:
    return d.atlas_nodes.select("node", "path", text.basename("path").alias("name"), text.dirname("path").alias("folder"), text.depth("path").alias("depth"), text.extension("path").alias("ext"))


@query("atlas_nodes", r"select node, path, regexp_matches(lower(path), '(^|/)(tests|test|__tests__|spec|specs)/') or regexp_matches(lower(path), '(^|/)test_[^/]*$|_test\.(py|go|rb)$|\.(test|spec)\.(ts|tsx|js|jsx)$|_spec\.rb$') as is_test from atlas_nodes")
def test_file_flag(d: Domain) -> DataFrame:
    return d.atlas_nodes.select("node", "path", text.is_test_file("path").alias("is_test"))


@query("packages", "select id, lower(regexp_replace(replace(name, ' ', '_.'), '[-_.]+', '-', 'g')) as name from packages")
def package_normalise(d: Domain) -> DataFrame:
    return d.packages.select("id", text.package_name(F.replace("name", F.lit(" "), F.lit("_."))).alias("name"))


@query(sql="select doc_id, sha256(text) as content_hash from documents")
def content_hash(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", text.content_hash("text").alias("content_hash"))


@query("jobs repos", """with p as (select id, id % (select ns from k) as repo_id, case when id % 7 = 0 then 'refs/heads/dev' else 'refs/heads/main' end as ref, case when id % 13 = 0 then '0000' else 'c' || (id % 5) end as after, id % 17 = 0 as truncated, id % 40 as n from jobs),
    s as (select id as repo_id, 'c1' as head_sha, case when id % 5 = 0 then timestamp '2024-01-01' else timestamp '2024-01-12' end as last_full_scan_at, id * 2 as node_count from repos where id % 6 > 0)
    select id, p.repo_id, n as changed, case when ref <> 'refs/heads/main' or after = '0000' then 'ignored' when head_sha = after then 'skipped'
    when node_count is null or node_count = 0 or last_full_scan_at < timestamp '2024-01-08' or n / node_count::double > 0.40 or truncated then 'full' else 'incremental' end as mode from p left join s on s.repo_id = p.repo_id""")  # fmt: skip
def push_delta_plan(d: Domain) -> DataFrame:
    n = (F.col("id") % 40).cast("int")
    paths = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    repos = d.table("supplier").count()
    pushes = d.jobs.select(
        (F.col("id") % repos).alias("repo_id"), F.when(F.col("id") % 7 == 0, "refs/heads/dev").otherwise("refs/heads/main").alias("ref"), F.lit("main").alias("default_branch"),
        F.when(F.col("id") % 13 == 0, "0000").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("after"), (F.col("id") % 17 == 0).alias("truncated"),
        F.array(F.struct(paths.alias("added"), paths.alias("modified"), none.alias("removed"))).alias("commits"), "id",
    )
    state = d.repos.where("id % 6 > 0").select(F.col("id").alias("repo_id"), F.lit("c1").alias("head_sha"), F.when(F.col("id") % 5 == 0, F.lit("2024-01-01")).otherwise("2024-01-12").cast("timestamp_ntz").alias("last_full_scan_at"), (F.col("id") * 2).alias("node_count"))
    plan = scheduling.push_plan(pushes, state, F.lit("2024-01-15").cast("timestamp_ntz"), keep=("id",))
    return plan.select("id", "repo_id", "changed", "mode")


def _hits(d: Domain) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return d.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("client"), seconds.alias("ts"))


@query(sql="""with recursive e as (select event_id as id, user_id % 5 as client, epoch_us(ts) / 1e6 as ts, row_number() over (partition by user_id % 5 order by ts, event_id) as n from events),
    f as (select id, client, n, [ts] as held, true as accepted, 0::bigint as retry_after from e where n = 1
    union all select id, client, n, case when len(k) < 5 then list_append(k, ts) else k end, len(k) < 5, case when len(k) < 5 then 0 else greatest(1, ceil(k[1] + 3600.0 - ts)) end::bigint
    from (select e.*, list_filter(f.held, lambda h: h > e.ts - 3600.0) as k from f join e on e.client = f.client and e.n = f.n + 1))
    select id, client, accepted, retry_after from f""")  # fmt: skip
def rate_limit(d: Domain) -> DataFrame:
    return stateful.rate_limited(_hits(d), limit=5, window=3600.0)


@query("incident_events", "select * exclude (rn) from (select *, row_number() over (partition by repo_id order by created_at desc, id desc) as rn from incident_events) where rn <= 20")
def fanout_capped(d: Domain) -> DataFrame:
    return stateful.fanned_out(d.incident_events, n=20)


STATE = "case event_type when 'usage_found' then 'pending' when 'patch_generated' then 'pending' when 'patch_failed' then 'failed' when 'validation_passed' then 'verified' when 'validation_failed' then 'failed' end"


@query("incident_events", f"""with recursive e as (select id, repo_id as incident, code_usage_id % 10 as usage, event_type, {STATE} as after, row_number() over (partition by repo_id order by created_at, id) as n from incident_events),
    f as (select 0::bigint as id, incident, 0::bigint as n, list_transform(range(10), lambda x: null::varchar) as held, 0::bigint as active, 0::bigint as resolved from e group by incident
    union all select id, incident, n,
        case when event_type = 'pr_opened' then list_transform(held, lambda s: case when s = 'verified' then 'resolved' else s end) when usage is not null and (held[usage + 1] is not null or event_type = 'usage_found') then list_transform(held, lambda s, i: case when i = usage + 1 then after else s end) else held end,
        case when event_type = 'pr_opened' then greatest(0, active - met) when usage is not null and event_type = 'usage_found' and held[usage + 1] is null then active + 1 else active end, resolved + case when event_type = 'pr_opened' then met else 0 end
    from (select e.*, held, active, resolved, len(list_filter(held, lambda s: s = 'verified')) as met from f join e on e.incident = f.incident and e.n = f.n + 1))
    select id, incident, active, resolved from f where n > 0""")  # fmt: skip
def incident_reducer(d: Domain) -> DataFrame:
    return stateful.reduced_incidents(d.incident_events.withColumn("incident", F.col("repo_id")).withColumn("usage", F.col("code_usage_id") % 10))


FACT = "case event_type when 'click' then 'heartbeat' when 'purchase' then 'done' when 'error' then 'failed' when 'view' then 'claimed' else 'claimed' end"
LEASE, RETRY = 43200.0, 14400.0  # of the query: its events are hours apart
UNTIL = 1706745600.0


@query(sql=f"""with recursive e as (select user_id as job, {FACT} as kind, event_id % 3 as worker, epoch_us(ts) / 1e6 as tm, row_number() over (partition by user_id order by ts, event_id) as n, count(*) over (partition by user_id) as total from events),
    a as (select * from e union all select distinct job, 'end', null, {UNTIL}, total + 1, total from e),
    f as (select job, 0::bigint as n, 1 as stage, 'queued' as status, 0 as attempts, 0.0::double as locked, -1::bigint as worker, '-inf'::double as due, []::struct(tm double, stage int, status varchar, attempts int)[] as seen from e group by job
    union all select job, n, case when kind = 'done' and s = 'running' and stage < 6 then stage + 1 else stage end,
        case when kind = 'claimed' and s = 'queued' and d <= tm then 'running' when kind = 'done' and s = 'running' then case when stage < 6 then 'queued' else 'done' end when kind = 'failed' and s = 'running' then case when attempts >= 3 then 'failed' else 'queued' end else s end,
        case when kind = 'claimed' and s = 'queued' and d <= tm then attempts + 1 when kind = 'done' and s = 'running' and stage < 6 then 0 else attempts end,
        case when kind = 'claimed' and s = 'queued' and d <= tm or kind = 'heartbeat' and s = 'running' and w = worker then tm else locked end,
        case when kind = 'claimed' and s = 'queued' and d <= tm then w else worker end,
        case when kind = 'done' and s = 'running' and stage < 6 then tm when kind = 'failed' and s = 'running' then tm + {RETRY} * attempts else d end,
        case when s <> status then [{{'tm': d, 'stage': stage, 'status': s, 'attempts': attempts}}] else [] end
        || case when kind = 'claimed' and s = 'queued' and d <= tm then [{{'tm': tm, 'stage': stage, 'status': 'running', 'attempts': attempts + 1}}]
            when kind = 'done' and s = 'running' then [{{'tm': tm, 'stage': case when stage < 6 then stage + 1 else stage end, 'status': case when stage < 6 then 'queued' else 'done' end, 'attempts': case when stage < 6 then 0 else attempts end}}]
            when kind = 'failed' and s = 'running' then [{{'tm': tm, 'stage': stage, 'status': case when attempts >= 3 then 'failed' else 'queued' end, 'attempts': attempts}}] else [] end
    from (select f.job, a.n, a.kind, a.worker as w, a.tm, stage, status, attempts, locked, f.worker, case when status = 'running' and locked + {LEASE} < a.tm then case when attempts >= 3 then 'failed' else 'queued' end else status end as s,
        case when status = 'running' and locked + {LEASE} < a.tm then locked + {LEASE} else due end as d from f join a on a.job = f.job and a.n = f.n + 1)),
    t as (select job, unnest(seen) as t from f)
    select job, t.tm as at, ['poll_registry', 'extract_changes', 'scan_repo', 'generate_patch', 'validate_patch', 'open_pr'][t.stage] as stage, t.status as status, t.attempts as attempts from t""")  # fmt: skip
def stage_machine(d: Domain) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    facts = d.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job"), F.expr(FACT).alias("kind"), (F.col("event_id") % 3).alias("worker"), seconds.alias("at"))
    return stages.staged(facts, UNTIL, stages.Rules(LEASE, RETRY))
