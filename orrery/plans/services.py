"""Queries of webhooks, stored tables, run records, path maps, coverage and other parts of the service."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import callsites, changelog, diffs, imports, text
from ..operators import graph, local, lookup, reporting, scheduling, scoring
from ..sources import payloads, sinks
from ..sources.scratch import new_path, written
from .bindings import Domain
from .fixtures import CHANGELOG, FITS, candidates, source_tree
from .local import CALLED, scanned
from .details import grounded_advice  # noqa: F401  (its statement is below)
from .queries import NOW, ORACLES, query

# HMAC's pads of one block, applied to the secret below.
SECRET, BLOCK, INNER, OUTER = "webhook-secret", 64, 0x36, 0x5C


def padded(pad: int) -> str:
    """The secret as HMAC puts it before a text, in hexadecimal."""
    return bytes(b ^ pad for b in SECRET.encode().ljust(BLOCK, b"\0")).hex()


@query(sql="select event_id, event_id % 3 = 0 and event_id % 7 > 0 as valid from events")
def webhook_signatures(d: Domain) -> DataFrame:
    """Signatures made by hashing with pads in SQL; a third are of another body, a third lack the prefix, a seventh have no secret."""
    sign = lambda body: f"sha2(concat(X'{padded(OUTER)}', unhex(sha2(concat(X'{padded(INNER)}', {body}), 256))), 256)"
    rows = d.table("events").selectExpr(
        "event_id", "encode(props, 'UTF-8') as body", f"if(event_id % 7 > 0, '{SECRET}', '') as secret",
        f"case event_id % 3 when 0 then concat('sha256=', {sign('encode(props, \'UTF-8\')')}) when 1 then concat('sha256=', {sign('encode(event_type, \'UTF-8\')')}) else {sign('encode(props, \'UTF-8\')')} end as header",
    )
    return rows.select("event_id", text.signature_valid("body", "header", "secret").alias("valid"))


PUSH_JSON = """concat('{"ref":"refs/heads/', if(event_id % 5 = 0, 'dev', 'main'), '","before":"', if(event_id % 4 = 0, repeat('0', 40), concat('b', event_id)), '",', if(event_id % 3 = 0, concat('"head_commit":{"id":"h', event_id, '"},'), concat('"after":"c', event_id, '",')),
    if(event_id % 11 = 0, '', concat('"repository":{"id":', user_id + 1, if(event_id % 2 = 0, ',"default_branch":"trunk"', ''), '},')), '"commits":[', array_join(transform(sequence(1, event_id % 23 + 1), i -> concat('{"added":["a', i, '"],"removed":["r', event_id, '"]}')), ','), ']', if(event_id % 13 = 0, '', '}'))"""


@query(sql="""select user_id + 1 as repo_id, 'refs/heads/' || case when event_id % 5 = 0 then 'dev' else 'main' end as ref, case when event_id % 2 = 0 then 'trunk' else 'main' end as default_branch, case when event_id % 4 > 0 then 'b' || event_id end as before,
    case when event_id % 3 = 0 then 'h' else 'c' end || event_id as after, event_id % 23 + 1 >= 20 as truncated, (event_id % 23 + 1)::int as commits, 'a' || (event_id % 23 + 1) as last_added from events where event_id % 11 > 0 and event_id % 13 > 0""")  # fmt: skip
def push_payloads(d: Domain) -> DataFrame:
    """Payloads are written as text lines and read back; every thirteenth is broken, every eleventh names no repository."""
    path = new_path(d.spark, "payloads")
    d.table("events").selectExpr(f"{PUSH_JSON} as value").write.text(path)
    rows = payloads.pushes(payloads.lines(d.spark, path))
    return rows.select("repo_id", "ref", "default_branch", "before", "after", "truncated", F.size("commits").alias("commits"), F.element_at("commits", -1)["added"][0].alias("last_added"))


HOOKS = """hooks as (select id as pr_id, 'closed' as action, id % 2 = 0 as merged, case when id % 10 = 0 then opened_at + interval 12 hour end as merged_at, case when id % 4 = 0 then opened_at + interval 13 hour end as closed_at, opened_at + interval 1 day as at from pull_requests where id % 3 = 0
    union all select id, 'reopened', null, null, null, opened_at + interval 2 day from pull_requests where id % 12 = 0 union all select id, 'labeled', true, null, null, opened_at + interval 9 day from pull_requests union all select id, 'closed', false, null, null, opened_at + interval 3 day from pull_requests where id % 24 = 0)"""
PRS = "prs as (select id, status, case when status <> 'open' then opened_at end as closed_at, status = 'merged' as merged, case when status = 'merged' then opened_at end as merged_at, opened_at from pull_requests)"


@query("pull_requests", f"""with {PRS}, {HOOKS.replace(' as at from', ' as came from')}, e as (select * from (select *, row_number() over (partition by pr_id order by came desc, action desc) as rn from hooks where action <> 'labeled') where rn = 1)
    select id, case when e.merged and action = 'closed' then 'merged' when action = 'closed' then 'closed' when action = 'reopened' then 'open' else status end as status, case when action = 'closed' then coalesce(e.closed_at, came) when action is null then p.closed_at end as closed_at,
    case when action = 'closed' then e.merged when action = 'reopened' then false else p.merged end as merged, case when action = 'closed' and e.merged then coalesce(e.merged_at, came) when action = 'reopened' then null else p.merged_at end as merged_at from prs p left join e on e.pr_id = p.id""")  # fmt: skip
def pr_transitions(d: Domain) -> DataFrame:
    pulls = d.pull_requests.withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz"))
    hook = lambda action, merged, merged_at, closed_at, days: ["id as pr_id", f"'{action}' as action", f"{merged} as merged", f"{merged_at} as merged_at", f"{closed_at} as closed_at", f"opened_at + interval {days} day as at"]
    none = "cast(null as timestamp_ntz)"
    hooks = pulls.where("id % 3 = 0").selectExpr(*hook("closed", "id % 2 = 0", "if(id % 10 = 0, opened_at + interval 12 hour, null)", "if(id % 4 = 0, opened_at + interval 13 hour, null)", 1))
    for rows, action, merged, days in ((pulls.where("id % 12 = 0"), "reopened", "cast(null as boolean)", 2), (pulls, "labeled", "true", 9), (pulls.where("id % 24 = 0"), "closed", "false", 3)):
        hooks = hooks.union(rows.selectExpr(*hook(action, merged, none, none, days)))
    prs = pulls.selectExpr("id", "status", "if(status <> 'open', opened_at, null) as closed_at", "status = 'merged' as merged", "if(status = 'merged', opened_at, null) as merged_at")
    return sinks.pr_transitions(prs, hooks)


@query("analysis_runs", f"""select repo_id, 'c' || id as commit_sha, case when id % 4 = 1 and date_diff('second', created_at::timestamp, {NOW} - interval 9200 day) > 120 then 'stale' when id % 4 = 1 then 'computing' when id % 4 = 2 then 'failed' else 'ready' end as status,
    case when id % 4 in (0, 3) then case when id % 5 = 0 then 'built' when repo_id % 3 = 0 then 'full' when 'c' || (repo_id * 7) <> 'c' || id then 'incremental' else 'full' end end as mode from analysis_runs""")  # fmt: skip
def graph_freshness(d: Domain) -> DataFrame:
    graphs = d.analysis_runs.selectExpr("repo_id", "concat('c', id) as commit_sha", "case id % 4 when 1 then 'computing' when 2 then 'failed' else 'ready' end as status", "created_at", "if(id % 5 = 0, 'built', null) as build_mode")
    states = d.repos.selectExpr("id as repo_id", "if(id % 3 = 0, '', concat('c', id * 7)) as last_full_scan_sha")
    now = d.spark.sql(f"select cast({NOW} - interval 9200 day as string) as now").first().now
    return graph.freshness(graphs, states, now)


SUMMED = f"""with found as ({ORACLES['findings']}), scores as ({ORACLES['repo_scores']}), nodes as ({ORACLES['fan_in_out']}),
    f as (select repo_id, count(*) as n, list(what order by rule)[1:3] as first from found group by repo_id), c as (select repo_id, count(*) as files from nodes group by repo_id)
    select s.repo_id, 'Repository ' || full_name || ' scored ' || score || '/100 across architectural structure, dependency health, and change safety. ' || coalesce(n, 0) || ' actionable findings identified across ' || coalesce(files, 0) || ' files.' as executive_summary,
    array_to_string(coalesce(first, ['Maintain continuous integration verification gates.']), chr(10)) as do_this_first from scores s left join f on f.repo_id = s.repo_id left join c on c.repo_id = s.repo_id"""


def _scored(d: Domain) -> DataFrame:
    from .queries import _signals

    return scoring.scored(_signals(d))


@query(sql=SUMMED)
def run_summaries(d: Domain) -> DataFrame:
    return scoring.summaries(scoring.with_findings(_scored(d))).select("repo_id", "executive_summary", F.array_join("do_this_first", "\n").alias("do_this_first"))


@query(sql=f"""with found as ({ORACLES['findings']}), scores as ({ORACLES['repo_scores']}), summed as ({SUMMED}), number as (select *, coalesce(verification::varchar, 'null') as v, coalesce(structure::varchar, 'null') as s, coalesce(dependency::varchar, 'null') as p, coalesce(change_safety::varchar, 'null') as c from scores),
    f as (select repo_id, count(*) as n, string_agg('{{"severity":"' || severity || '","title":"' || title || '","what_to_do":"' || what || '"}}', ',' order by rule) as listed from found group by repo_id)
    select repo_id, 'h' || repo_id as head_sha, score, '{{"structure":' || s || ',"dependency":' || p || ',"change_safety":' || c || ',"verification":' || v || '}}' as sub_scores, sha256('[' || coalesce(listed, '') || ']') as findings, executive_summary, do_this_first from number left join f using (repo_id) join summed using (repo_id)""")  # fmt: skip
def run_records(d: Domain) -> DataFrame:
    """Run records are made once, appended as one batch, twice, and read back."""
    scores, path = scoring.with_findings(_scored(d)), new_path(d.spark, "run-records")
    head = F.concat(F.lit("h"), F.col("repo_id").cast("string"))
    records = written(scoring.run_records(scores.withColumn("head", head), "head", F.expr(NOW)), "new-records")
    for _ in range(2):
        sinks.append_once(records, path, 7)
    stored = d.spark.read.parquet(path)
    return stored.select("repo_id", "head_sha", "score", "sub_scores", F.sha2("findings", 256).alias("findings"), "executive_summary", F.array_join("do_this_first", "\n").alias("do_this_first"))


@query("analysis_runs", "select id, repo_id, score, coalesce(score - lag(score) over (partition by repo_id order by created_at, id), 0) as delta, id % 3 as batch from analysis_runs")
def stored_runs(d: Domain) -> DataFrame:
    """Runs are appended in three batches, two of them twice; the table that is read back has each once."""
    path = new_path(d.spark, "runs")
    for batch in (0, 1, 1, 2, 0):
        sinks.append_once(d.analysis_runs.where(F.col("id") % 3 == batch), path, batch)
    stored = d.spark.read.schema("id long, repo_id long, score long, created_at timestamp_ntz, batch long").parquet(path)
    return reporting.run_deltas(stored).join(stored.select("id", "batch"), "id")


@query(sql=f"with {FITS} select usage, ordinal, fits as ok from f")
def loose_diffs(d: Domain) -> DataFrame:
    """The patches of ``diff_apply`` on files with other white space inside their lines."""
    rows = candidates(d).withColumn("original", F.regexp_replace("original", "^a", "a  ")).withColumn("diff", F.regexp_replace("diff", "\n a", "\n a \t"))
    return rows.select("usage", "ordinal", diffs.apply_diff_loosely("original", "diff")["ok"].alias("ok"))


@query(sql="""with recursive e as (select event_id as id, user_id % 40 as who, epoch_us(ts) / 1e6 as ts, row_number() over (partition by user_id % 40 order by ts, event_id) as n from events),
    f as (select id, who, n, ts as last, true as accepted from e where n = 1 union all select e.id, e.who, e.n, case when last <= e.ts - 7200.0 then e.ts else last end, last <= e.ts - 7200.0 from f join e on e.who = f.who and e.n = f.n + 1)
    select id, accepted from f""")  # fmt: skip
def cooldown(d: Domain) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    asked = d.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 40 % 8).alias("user"), F.floor(F.col("user_id") % 40 / 8).alias("repo_id"), seconds.alias("ts"))
    return lookup.in_cooldown(asked, 7200)


@query(sql="select 'send' || p_partkey as symbol, 'wire' as package, p_partkey % 3 = 0 as covered from part")
def covered_symbols(d: Domain) -> DataFrame:
    """Every third symbol is called in a test; the others in plain files, or in a test's comment."""
    sources = d.table("part").selectExpr(
        "concat(if(p_partkey % 3 = 1, 'src/', 'tests/'), 'f', p_partkey, '.ts') as path", "concat('send', p_partkey) as symbol", "'wire' as package", "cast(null as array<string>) as import_names",
        "concat('import { send', p_partkey, ' } from \"wire\";\\n', if(p_partkey % 3 = 2, '// ', ''), 'send', p_partkey, '(', p_size, ');\\n') as source",
    )
    return callsites.covered_by_tests(sources)


# A file in each language with one call that counts and one of another package: ending, text before the call, the call, text behind it, symbol, package.
CALLING = (
    (".go", 'package main\\nimport "acme/wire"\\nfunc main() {\\n\\t', "wire.Send({})", "\\n\\tother.Send(2)\\n}\\n", "Send", "acme/wire"),
    (".rs", "use wire::Client;\\nfn main() {\\n    ", "Client::send({})", ";\\n    Other::send(2);\\n}\\n", "send", "wire"),
    (".java", "import acme.wire.Client;\\nclass A { void b() {\\n  ", "Client.send({})", ";\\n  Other.send(2);\\n} }\\n", "send", "acme.wire"),
    (".rb", "require 'wire'\\n", "Wire.send({})", "\\nOther.send(2)\\n", "send", "wire"),
    (".cs", "using Acme.Wire;\\nclass A { void B() {\\n  ", "Client.Send({})", ";\\n  other.Send(2);\\n} }\\n", "Send", "Acme.Wire"),
    (".js", "const { send: go } = require('wire');\\n", "go({})", ";\\nsend(2);\\n", "send", "wire"),
)


def called(language: int) -> tuple[int, int]:
    """Line and first byte of the call."""
    before = CALLING[language][1].replace("\\n", "\n").replace("\\t", "\t")
    return before.count("\n") + 1, len(before)


@query(sql=f"""with l as (select * from (values {", ".join(f"({i}, '{x[0]}', '{x[4]}', '{x[5]}', '{x[2].split('{}')[0]}', {called(i)[0]}, {called(i)[1]})" for i, x in enumerate(CALLING))}) as t(i, ending, symbol, package, head, line, start))
    select 'p' || p_partkey || ending as path, symbol, package, line as line_start, start as start_byte, (start + length(head || p_size || ')'))::int as end_byte, head || p_size || ')' as snippet from part join l on i = p_partkey % {len(CALLING)}""")  # fmt: skip
def language_calls(d: Domain) -> DataFrame:
    quoted = lambda text: "'" + text.replace("'", "\\'") + "'"
    pick = lambda at: f"element_at(array({', '.join(quoted(x[at]) for x in CALLING)}), cast(p_partkey % {len(CALLING)} as int) + 1)"
    sources = d.table("part").selectExpr(f"concat('p', p_partkey, {pick(0)}) as path", f"concat({pick(1)}, replace({pick(2)}, '{{}}', p_size), {pick(3)}) as source", f"{pick(4)} as symbol", f"{pick(5)} as package", "cast(null as array<string>) as import_names")
    return callsites.call_sites(sources, capitals=True).drop("line_end")


@query("atlas_edges", "select distinct repo_id, source_path, target_path from atlas_edges where source_path not like '%.md' and target_path not like '%.py'")
def known_edges(d: Domain) -> DataFrame:
    """Edges from nodes that are known as sources to nodes that are known as targets."""
    nodes = d.atlas_nodes
    left = graph.known_edges(nodes.where("ext <> '.md'").union(nodes.where("ext = '.md'").withColumn("repo_id", F.lit(-1).cast("long"))), d.atlas_edges)
    kept = left.join(nodes.where("ext <> '.py'").select("repo_id", F.col("path").alias("target_path")), ["repo_id", "target_path"], "left_semi")
    extra = d.atlas_edges.where("target_path like '%.md' and source_path not like '%.md'").select("repo_id", "target_path", "source_path")
    return kept.select("repo_id", "source_path", "target_path").union(extra.select("repo_id", "source_path", "target_path")).distinct()


@query("k atlas_nodes", """with n as (select repo_id, 'src/n' || node || case place % 8 when 0 then '.ts' when 1 then '.py' when 2 then '.go' when 3 then '.c' when 4 then '.rs' when 5 then '.rb' when 6 then '.php' else '.js' end as path from (select *, node // (select ns from k) as place from atlas_nodes)
    union all select distinct repo_id, 'tsconfig.json' from atlas_nodes), r as (select *, row_number() over (partition by repo_id order by path) as rn, count(*) over (partition by repo_id) as total from n)
    select repo_id, path, total > 12 as truncated from r where rn <= 12""")  # fmt: skip
def truncated_files(d: Domain) -> DataFrame:
    return imports.files(source_tree(d), limit=12).select("repo_id", "path", "truncated")


@query("jobs", "select package_id, version, min(id) as n from jobs where id % 4 > 0 and (package_id, version) not in (select (package_id, version) from jobs where id % 4 = 0) group by package_id, version")
def new_versions(d: Domain) -> DataFrame:
    """Versions seen anew, each once; the greatest row of a key is kept, so the least id is negated."""
    seen = d.jobs.select("package_id", "version", "id")
    new = seen.where("id % 4 > 0").select("package_id", "version", (-F.col("id")).alias("id"))
    return sinks.insert_absent(seen.where("id % 4 = 0"), new, ["package_id", "version"]).select("package_id", "version", (-F.col("id")).alias("n"))


@query("code_usages", """with c as (select *, id % 3 as line_start, id % 5 as line_end from code_usages), a as (select repo_id, detected_change_id, file_path, line_start, max(line_end) as line_end from c where id % 2 = 1 group by all)
    select a.* from a where not exists (select 1 from c where id % 2 = 0 and c.repo_id = a.repo_id and c.detected_change_id = a.detected_change_id and c.file_path = a.file_path and c.line_start = a.line_start)""")  # fmt: skip
def new_usages(d: Domain) -> DataFrame:
    rows = d.code_usages.selectExpr("id", "repo_id", "detected_change_id", "file_path", "id % 3 as line_start", "id % 5 as line_end")
    keys = ["repo_id", "detected_change_id", "file_path", "line_start"]
    return sinks.insert_absent(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").select(*keys, "line_end"), keys)


@query("repos", "select id, case when id % 2 = 0 and id % 3 > 0 then id % 4 = 0 else requires_tests end as requires_tests, case when id % 2 = 0 and id % 5 > 0 then true else requires_typecheck end as requires_typecheck, is_active from repos")
def repo_policies(d: Domain) -> DataFrame:
    patch = d.repos.where("id % 2 = 0").selectExpr("id", "if(id % 3 > 0, id % 4 = 0, null) as requires_tests", "if(id % 5 > 0, true, null) as requires_typecheck")
    return sinks.partial_update(d.repos.select("id", "requires_tests", "requires_typecheck", "is_active"), patch)


@query(sql=f"""with t as (select doc_id, lang, regexp_replace(text, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') as body from documents)
    select doc_id, case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'transient' else 'unknown' end as classification, sha256(case when doc_id % 3 = 0 then lang when doc_id % 3 = 2 then '{text.NOT_JSON}["' || lang || '"]' when body = '' then '{text.NO_CONTENT}' else '{text.NOT_JSON}' || left(body, 200) end) as reasoning,
    case when doc_id % 3 = 0 then 'do ' || doc_id else '{text.RETRY_ONCE}' end as action from t""")  # fmt: skip
def failure_answers(d: Domain) -> DataFrame:
    """Answers from whole texts: a third JSON objects in fences, a third the text itself, a third JSON lists."""
    answer = """case doc_id % 3 when 0 then concat('ok\n```json\n{"classification":"', if(doc_id % 2 = 0, 'transient', 'odd'), '","reasoning":"', lang, '","recommended_action":"do ', doc_id, '"}\n```') when 1 then text else concat('["', lang, '"]') end"""
    rows = d.table("documents").selectExpr("doc_id", f"{answer} as answer").select("doc_id", text.failure_answer("answer").alias("a"))
    return rows.select("doc_id", F.col("a.classification").alias("classification"), F.sha2("a.reasoning", 256).alias("reasoning"), F.col("a.recommended_action").alias("action"))


@query(sql=f"""with c as ({ORACLES['changelog_changes']}), l as (select id, string_agg('  ' || n || '. [' || upper(change_type) || '] ' || symbol || coalesce(' -> ' || symbol_new, '') || ' (confidence: ' || round_even(confidence * 100, 0)::int || '%)' || chr(10) || '     ' || description, chr(10) order by n) as body
    from (select *, row_number() over (partition by id order by position) as n from c) group by id)
    select p_partkey as id, case when p_partkey % 7 = 0 then 2 else 0 end as exit_code, case when p_partkey % 7 = 0 then 'Error: changelog file not found: c' || p_partkey else 'Breaking change analysis for ' || p_name || ' (1.0 -> 2.' || p_size || '):' || chr(10) || case when p_partkey % 5 = 0 then '  No breaking changes detected.' else body end end as text
    from part left join l on l.id = p_partkey""")  # fmt: skip
def analysis_reports(d: Domain) -> DataFrame:
    """Every seventh request names a changelog that is not there, every fifth an empty one."""
    rows = d.table("part").selectExpr("p_partkey as id", "p_name as package", "'1.0' as old_version", "concat('2.', p_size) as version", f"case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then '' else {CHANGELOG} end as changelog", "concat('c', p_partkey) as named")
    return local.analysis_lines(rows, changelog.changelog_changes(rows.where("changelog is not null").select("id", "changelog")), "id")


@query("atlas_nodes repos", f"""with {CALLED}, u as (select repo_id, path, case when path like '%.py' then 12 else length('import {{ send }} from ''wire'';' || chr(10)) end as start_byte, snippet from called)
    select r.id as repo_id, '{{"count":' || count(path) || ',"usages":[' || coalesce(string_agg('{{"file_path":"' || path || '","line_start":2,"start_byte":' || start_byte || ',"end_byte":' || (start_byte + length(snippet)) || ',"snippet":"' || snippet || '"}}', ',' order by path), '') || ']}}' as json from repos r left join u on u.repo_id = r.id group by r.id""")  # fmt: skip
def scan_documents(d: Domain) -> DataFrame:
    return local.scan_documents(scanned(d), d.repos.select(F.col("id").alias("repo_id")), "repo_id")


@query("jobs", f"select id, attempts from jobs where status = 'queued' and run_after <= {NOW} order by created_at, id limit 20 offset 40")
def due_page(d: Domain) -> DataFrame:
    return scheduling.due_page(d.jobs, F.expr(NOW.replace("timestamp", "timestamp_ntz")), 40).select("id", "attempts")


@query(sql="""select l_orderkey, l_linenumber, greatest(0.3, least(1.2, l_quantity / 80.0))::double as radius, (l_discount * 50)::double as x, (l_quantity * 0.5)::double as z from lineitem""")
def scene_sizes(d: Domain) -> DataFrame:
    """Radius of call sites of that many lines, and the horizontal middle of wires to the origin."""
    rows = d.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "0 as line_start", "l_quantity as line_end", "0.0d as zero", "l_discount * 100 as x2", "l_tax * 20 as y2", "l_quantity as z2")
    middle = graph.wire_middle("zero", "zero", "zero", "x2", "y2", "z2")
    return rows.select("l_orderkey", "l_linenumber", lookup.node_radius("line_start", "line_end").cast("double").alias("radius"), middle["x"].cast("double").alias("x"), middle["z"].cast("double").alias("z"))


ADVISED = f"""with found as ({ORACLES['findings']}), g as (select repo_id as id, list(lower(concat_ws(' ', title, why, what))) as texts, list(what) || case when repo_id % 2 = 0 then ['Break the import cycle in src/invented.ts'] else [] end as advice,
    flatten(list(case when contains(link, 'focus=') then [regexp_extract(link, 'focus=([^&]*)', 1)] else [] end || list_transform(list_filter(string_split_regex(title, '\\s+'), lambda w: w <> '' and (contains(w, '/') or regexp_matches(w, '\\.(ts|js|py|go|rs|json)$'))), lambda w: regexp_replace(w, '^[`''",():]+|[`''",():]+$', '', 'g')))) as files from found group by repo_id),
    a as (select id, texts, files, unnest(advice) as item from g),
    t as (select *, list_transform(list_filter(string_split_regex(item, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[`''",():;]+|[`''",():;]+$', '', 'g')) as words from a),
    s as (select id, regexp_matches(lower(item), '{'|'.join(lookup.TOPICS)}') and len(list_filter(texts, lambda x: len(list_filter(string_split_regex(lower(item), '\\s+'), lambda w: length(w) > 3 and contains(x, w))) > 0)) > 0
        and len(list_filter(words, lambda w: (starts_with(w, '@') and contains(w, '/')) or ((contains(w, '/') or regexp_matches(w, '\\.(ts|tsx|js|jsx|py)$')) and not starts_with(w, 'http') and len(list_filter(files, lambda f: contains(f, w))) = 0))) = 0 as sound from t)
    select id, bool_and(sound) as grounded from s group by id"""
ORACLES["grounded_advice"] = ADVISED
