"""Queries of readers, column functions, small joins, sinks and streams' predicates, on inputs derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import diffs, text
from ..operators import graph, local, lookup, reporting as r, scheduling
from ..sources import readers, sinks
from ..streaming import graph_updates
from .bindings import Domain
from .queries import DEGREES, LAST_RUN, NOW, RISK, SCOPE, query
from ..operators import tenancy

VERSION = "concat(cast(p_size as string), '.', cast(p_partkey % 10 as string))"


def _part(d: Domain, **columns: str) -> DataFrame:
    return d.table("part").selectExpr("p_partkey as id", *(f"{v} as {k}" for k, v in columns.items()))


NPM = f"""concat('{{"dist-tags":{{"latest":"', if(p_size % 10 = 0, '', {VERSION}), '"}},"time":{{"', {VERSION}, '":"2024-01-02T03:04:05Z"}},"versions":{{"0.0.1":{{}},"', {VERSION}, '":{{',
    if(p_size % 3 = 0, '"homepage":"http://h/1"', '"repository":{{"url":"git://r/2"}}'), ',"changelog":"', p_brand, '"}}}}}}')"""
PYPI = f"""concat('{{"info":{{"version":"', if(p_size % 10 = 0, '', {VERSION}), '","home_page":"http://home","project_urls":{{', if(p_size % 3 = 0, '"Changes":"http://c"', ''), '}},"description":"', p_brand, '"}},"releases":{{"0.0.1":[],"', {VERSION}, '":[',
    if(p_size % 4 = 0, '', '{{"upload_time_iso_8601":"2024-02-03T04:05:06Z"}}'), ']}},"urls":[{{"upload_time_iso_8601":"2024-03-04T05:06:07Z"}}]}}')"""
SQL_VERSION = "case when p_size % 10 > 0 then p_size || '.' || p_partkey % 10 end"


@query(sql=f"""select p_partkey as id, {SQL_VERSION} as version, case when p_size % 10 = 0 then null when p_partkey % 2 = 0 then timestamp '2024-01-02 03:04:05' when p_size % 4 = 0 then timestamp '2024-03-04 05:06:07' else timestamp '2024-02-03 04:05:06' end as published_at,
    case when p_size % 10 = 0 then null when p_partkey % 2 = 0 then case when p_size % 3 = 0 then 'http://h/1' else 'git://r/2' end when p_size % 3 = 0 then 'http://c' else 'http://home' end as url, case when p_size % 10 > 0 then p_brand end as notes from part""")  # fmt: skip
def registry_latest(d: Domain) -> DataFrame:
    answers = _part(d, name="cast(p_partkey as string)", ecosystem="if(p_partkey % 2 = 0, ' NPM ', 'pypi')", json=f"if(p_partkey % 2 = 0, {NPM}, {PYPI})")
    return readers.latest_versions(answers).select(F.col("name").cast("long").alias("id"), "version", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "url", "notes")


@query(sql="select p_partkey as id, case when p_partkey % 3 < 2 then p_size || '.' || p_partkey % 10 || ',0.0.1' end as versions from part")
def registry_versions(d: Domain) -> DataFrame:
    answers = _part(d, name="cast(p_partkey as string)", ecosystem="case p_partkey % 3 when 0 then 'npm' when 1 then 'pypi' else 'cargo' end", json=f"if(p_partkey % 3 = 0, {NPM}, {PYPI})")
    return readers.all_versions(answers).select(F.col("name").cast("long").alias("id"), F.array_join("versions", ",").alias("versions"))


@query("atlas_nodes", "select node, path from atlas_nodes where node % 7 > 0 and regexp_matches(path, '[.](ts|tsx|js|jsx|mjs|cjs|py)$') and node * 5000 <= 500000")
def repair_scope(d: Domain) -> DataFrame:
    blobs = d.atlas_nodes.select("node", "path", F.when(F.col("node") % 7 == 0, "tree").otherwise("blob").alias("type"), (F.col("node") * 5000).alias("size"))
    return readers.repair_scope(blobs).select("node", "path")


@query(sql="select o_orderkey as id, 's' || o_orderkey as sha, o_orderpriority as author, case when o_orderkey % 2 = 0 then 'fix|' || o_orderstatus else 'plain' end as message from orders where o_orderkey % 5 > 0")
def git_log(d: Domain) -> DataFrame:
    lines = d.table("orders").selectExpr("if(o_orderkey % 5 = 0, 'short|line', concat('s', o_orderkey, '|', o_orderpriority, '|m@x|', o_orderdate, '|', if(o_orderkey % 2 = 0, concat('fix|', o_orderstatus), 'plain'))) as value")
    return readers.git_log(lines).select(F.substring("sha", 2, 30).cast("long").alias("id"), "sha", "author", "message")


@query(sql=f"""select o_orderkey as id, o_orderpriority as author, 'first ' || o_orderstatus as message, case when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h ago' when s < 2592000 then s // 86400 || 'd ago'
    else strftime(then_, '%b %d, %Y') end as committed from (select *, timestamp '2024-01-15' - to_seconds(o_orderkey * o_orderkey % 9999991) as then_, o_orderkey * o_orderkey % 9999991 as s from orders)""")  # fmt: skip
def recent_commits(d: Domain) -> DataFrame:
    at = "date_format(timestamp '2024-01-15 00:00:00' - make_dt_interval(0, 0, 0, o_orderkey * o_orderkey % 9999991), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    answers = d.table("orders").selectExpr("o_orderkey as id", f"{at} as iso", f"""concat('{{"sha":"x","commit":{{"author":{{"name":"', o_orderpriority, '","date":"', {at}, '"}},"message":"first ', o_orderstatus, '\\\\nsecond"}}}}') as json""")
    return readers.commits(answers, "id", "iso").select("id", "author", "message", text.relative_time("iso", F.expr("timestamp '2024-01-15 00:00:00'")).alias("committed"))


@query(sql="select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as at from events group by user_id")
def last_commits(d: Domain) -> DataFrame:
    changes = d.table("events").select(F.col("user_id").alias("path"), F.col("event_id").alias("sha"), F.col("ts").alias("at"))
    return readers.last_commits(changes).select(F.col("path").alias("user_id"), F.col("sha").alias("event_id"), "at")


@query(sql="select doc_id, case when contains(text, chr(0)) then null when length(text) > 1000000 then sha256(substr(text, 1, 1000000) || chr(10) || chr(10) || '… (truncated, file exceeds 1MB preview limit)') else sha256(text) end as shown from documents")
def file_preview(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.sha2(readers.preview(F.col("text")), 256).alias("shown"))


@query(sql="select p_partkey as id, case p_partkey % 3 when 0 then 'a,b,c,d,e,f' when 1 then 'flask,' || lower(p_brand) else 'numpy' end as names from part")
def manifest_dependencies(d: Domain) -> DataFrame:
    rows = _part(
        d, package="""if(p_partkey % 3 = 0, '{"dependencies":{"a":"1","b":"1","c":"1","d":"1","e":"1","f":"1","g":"1"}}', '{"dependencies":{}}')""",
        requirements="if(p_partkey % 3 = 1, concat('# pinned\\nflask==2\\n\\n', lower(p_brand), '>=1'), 'numpy')",
    )
    return rows.select("id", F.array_join(readers.dependencies("package", "requirements"), ",").alias("names"))


@query("validation_runs", """select patch_id, tie, tie2, tie3, case when patch_id % 9 = 0 then '[Warning] No verification run recorded for this patch.' when verification_mode <> 'full' then '[Warning] No test suite detected in this repo — this patch was validated by parse and type-check only, not by running tests.'
    when tests_pass and typechecks then '[Verified] Repo''s own test suite and type-checker both passed on this patch.' when tests_pass then '[Verified] Repo''s own test suite passed on this patch (type-check not run / not configured).' else '[Verified] Isolated sandbox verification passed on this patch.' end as disclosure from validation_runs""")  # fmt: skip
def disclosure(d: Domain) -> DataFrame:
    said = text.disclosure(F.col("patch_id") % 9 != 0, F.col("verification_mode"), F.col("tests_pass"), F.col("typechecks"))
    return d.validation_runs.select("patch_id", "tie", "tie2", "tie3", said.alias("disclosure"))


@query("detected_changes", f"""select id, '## Change classification' || chr(10) || '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || '| Change type | ' || change_type || ' |' || chr(10) || '| Classifier confidence | ' || round_even(confidence * 100, 0)::int || '% |' || chr(10)
    || '| Risk flag | ' || case when {RISK} then '[Warning] Possible semantic/behavior change — passing tests do not guarantee old behavior is preserved' else '[Safe] Mechanical change' end || ' |' || chr(10) || '| Install scripts | ' || case when id % 5 = 0 then 'allowed (opt-in)' else 'blocked (default)' end || ' |' || chr(10)
    || case when id % 2 = 0 then chr(10) || '> [Review Required] Human review required before merge — see risk flag above.' || chr(10) else '' end as body, case when {RISK} and not starts_with(symbol, '[semantic-risk]') then '[semantic-risk] ' || symbol else symbol end as title from detected_changes""")  # fmt: skip
def pr_body(d: Domain) -> DataFrame:
    table = text.classification_table(F.col("change_type"), F.col("confidence"), r.semantic_risk(), F.col("id") % 5 == 0, F.col("id") % 2 == 0)
    return d.detected_changes.select("id", table.alias("body"), text.pr_title(F.col("symbol"), r.semantic_risk()).alias("title"))


@query(sql="select page_id, case page_id % 8 when 0 then true when 1 then false when 2 then true when 3 then true when 4 then false when 5 then true when 6 then false else false end as allowed from pages")
def redirect_allowed(d: Domain) -> DataFrame:
    url = F.expr("element_at(array('/next?x=1', '//evil.org/', 'https://OK.org/a', 'http://localhost:3000/b', 'https://ok.org:8443/', 'http://127.0.0.1/', 'ftp://ok.org/', 'https://notok.org/'), cast(page_id % 8 + 1 as int))")
    return d.table("pages").select("page_id", text.redirect_allowed(url, ("ok.org",)).alias("allowed"))


@query(sql="select doc_id, regexp_matches(lower(text), '503|429|504|unavailable|deadline|resource_exhausted') as is_transient from documents")
def transient_errors(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", text.transient_error("text").alias("is_transient"))


@query("jobs", "select id, attempts * 30 as retry, case when attempts > 0 then least(8000, 1000 * pow(2, attempts - 1))::bigint else 500 end as backoff, 2.0::double * pow(2, attempts - 1) as transient from jobs")
def retry_delays(d: Domain) -> DataFrame:
    return d.jobs.select("id", scheduling.retry_delay("attempts").alias("retry"), scheduling.client_backoff_ms("attempts").alias("backoff"), text.transient_delay("attempts").alias("transient"))


@query("analysis_runs", "select id, round(-130 + greatest(0, least(100, score)) / 100.0::double * 260, 6) as angle from analysis_runs")
def needle_angle(d: Domain) -> DataFrame:
    return d.analysis_runs.select("id", F.round(lookup.needle_angle("score"), 6).alias("angle"))


@query(sql=r"select doc_id, sha256(regexp_replace(regexp_replace(text, '[\s\x0b]+', ' ', 'g'), '^ | $', '', 'g')) as squeezed from documents")
def squeezed_text(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.sha2(text.squeezed("text"), 256).alias("squeezed"))


@query(sql="select doc_id, sha256(left(text, 8000)) as changelog, sha256(left(text, 2000)) as error, sha256(left(text, 200)) as job_error from documents")
def bounded_texts(d: Domain) -> DataFrame:
    cut = lambda n: F.sha2(text.bounded("text", n), 256)
    return d.table("documents").select("doc_id", cut(text.CHANGELOG_CHARS).alias("changelog"), cut(text.ERROR_CHARS).alias("error"), cut(text.JOB_ERROR_CHARS).alias("job_error"))


@query(sql="""select p_partkey as id, case p_partkey % 3 when 0 then 'bs4,beautifulsoup4' when 1 then 'my_pkg' else 'sklearn,scikit_learn' end as names, case p_partkey % 3 when 0 then 'beautifulsoup4' when 1 then '@scope/my%20pkg' else 'Scikit_Learn' end as registry from part""")
def package_names(d: Domain) -> DataFrame:
    rows = _part(d, name="case p_partkey % 3 when 0 then 'beautifulsoup4' when 1 then 'My.-Pkg' else 'Scikit_Learn' end", wanted="case p_partkey % 3 when 0 then 'beautifulsoup4' when 1 then '@scope/my pkg' else 'Scikit_Learn' end")
    # shortest first; a scan tries them from the end
    return rows.select("id", F.array_join(F.array_sort(text.import_names("name"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).otherwise(1)), ",").alias("names"), text.registry_name("wanted").alias("registry"))


ANSWERS = """case p_partkey % 4 when 0 then concat('```json\\n[{"symbol_old":"', p_brand, '","symbol":"no","confidence":0.5},{"symbol_new":"b","change_type":"removed","confidence":"0.', p_size, '"}]\\n```') when 1 then '[]' when 2 then '{"classification":"transient"}' else '```\\n{"classification":"odd"}\\n```' end"""


@query(sql="""select p_partkey as id, case p_partkey % 4 when 0 then 2 when 1 then 0 end as changes, case p_partkey % 4 when 0 then p_brand || ' signature_change 0.5' end as first_change, case p_partkey % 4 when 0 then ':b:removed:' || ('0.' || p_size)::double end as second_change, case p_partkey % 4 when 2 then 'transient' else 'unknown' end as failure from part""")
def provider_answers(d: Domain) -> DataFrame:
    rows = _part(d, answer=ANSWERS).withColumn("c", text.extracted_changes("answer"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    later = F.when(second.isNotNull(), F.concat_ws(":", second["symbol_old"], second["symbol_new"], second["change_type"], second["confidence"].cast("string")))
    return rows.select("id", F.when(F.col("c").isNotNull(), F.size("c")).alias("changes"), F.when(first.isNotNull(), F.concat_ws(" ", first["symbol_old"], first["change_type"], first["confidence"].cast("string"))).alias("first_change"), later.alias("second_change"), text.failure_class("answer").alias("failure"))


@query(sql="""select p_partkey as id, case p_partkey % 4 when 0 then '--- a' || chr(10) || '+++ ' || p_brand when 1 then 'UNABLE_TO_PATCH' when 2 then '@@ -1 +1 @@' || chr(10) || '+x' else 'UNABLE_TO_PATCH' end as diff,
    case when p_size % 2 = 0 then 'abc' || p_size end as base_sha from part""")  # fmt: skip
def provider_diffs(d: Domain) -> DataFrame:
    rows = _part(d, answer="case p_partkey % 4 when 0 then concat('ok\\n```diff\\n--- a\\n+++ ', p_brand, '\\n```') when 1 then 'UNABLE_TO_PATCH: no' when 2 then '@@ -1 +1 @@\\n+x\\n' else 'no diff at all' end", log="if(p_size % 2 = 0, concat('[base_sha:abc', p_size, '] done'), 'done')")
    return rows.select("id", text.extracted_diff("answer").alias("diff"), text.log_sha(F.col("log"), "base").alias("base_sha"))


GATES = "requires_tests, requires_typecheck, q.id % 5 = 0 as has_test, q.id % 7 = 0 as has_typecheck, score % 3 > 0 as workflow_ok, score % 10 > 0 as completed from validation_runs v join patches p on p.id = v.patch_id join code_usages u on u.id = p.code_usage_id join repos q on q.id = u.repo_id join analysis_runs a on a.id = u.id"


def _gated(d: Domain) -> DataFrame:
    usage = d.code_usages.select(F.col("id").alias("code_usage_id"), "repo_id").join(d.repos.select(F.col("id").alias("repo_id"), "requires_tests", "requires_typecheck", (F.col("id") % 5 == 0).alias("has_test"), (F.col("id") % 7 == 0).alias("has_typecheck")), "repo_id")
    usage = usage.join(d.analysis_runs.select(F.col("id").alias("code_usage_id"), (F.col("score") % 3 > 0).alias("workflow_ok"), (F.col("score") % 10 > 0).alias("completed")), "code_usage_id")
    return d.validation_runs.join(d.patches.select(F.col("id").alias("patch_id"), "code_usage_id"), "patch_id").join(usage, "code_usage_id")


@query("validation_runs patches code_usages repos analysis_runs", f"""select patch_id, tie, tie2, tie3, case when (requires_tests and tests_pass is not true) or (requires_typecheck and typechecks is not true) or not workflow_ok then 'failed' else 'verified' end as gate,
    completed and workflow_ok and applies_cleanly is true and parses is true and scope_ok is true and case when requires_tests or has_test then tests_pass is true else tests_pass is not false end and case when requires_typecheck or has_typecheck then typechecks is true else typechecks is not false end as strict,
    case when completed then tests_pass else false end as recorded_tests, case when completed then typechecks else false end as recorded_types, case when completed then 'github_actions' else 'github_actions_unresponsive' end as mode
    from (select patch_id, tie, tie2, tie3, tests_pass, typechecks, applies_cleanly, parses, scope_ok, {GATES})""")  # fmt: skip
def patch_gates(d: Domain) -> DataFrame:
    lenient = diffs.gate("tests_pass", "typechecks", "requires_tests", "requires_typecheck", "workflow_ok")
    strict = diffs.strict_gate("applies_cleanly", "parses", "scope_ok", "tests_pass", "typechecks", "requires_tests", "requires_typecheck", "has_test", "has_typecheck", "completed", "workflow_ok")
    recorded = diffs.strict_results("tests_pass", "typechecks", "completed")
    rows = _gated(d).select("patch_id", "tie", "tie2", "tie3", lenient.alias("gate"), strict.alias("strict"), recorded.alias("r"))
    return rows.select("patch_id", "tie", "tie2", "tie3", "gate", "strict", F.col("r.tests_pass").alias("recorded_tests"), F.col("r.typechecks").alias("recorded_types"), F.col("r.verification_mode").alias("mode"))


@query("jobs", "select id, old_version from (select *, lag(version) over (partition by package_id order by locked_at nulls first, id) as old_version from jobs) where old_version is not null")
def baseline_versions(d: Domain) -> DataFrame:
    versions = r.previous_version(d.jobs.withColumn("published_at", F.col("locked_at")), ["package_id"])
    return scheduling.baseline(versions).select("id", "old_version")


@query("patches code_usages detected_changes", "select u.repo_id, c.package_id as version_id, p.id as patch_id from patches p join code_usages u on u.id = p.code_usage_id join detected_changes c on c.id = u.detected_change_id where verified")
def version_patches(d: Domain) -> DataFrame:
    return r.version_patches(d.patches, d.code_usages, d.detected_changes)


@query("repos installations users repo_packages packages", f"with scope as ({SCOPE}) select distinct user_id, package_id from scope join repo_packages using (repo_id) where package_id in (select id from packages)")
def package_access(d: Domain) -> DataFrame:
    return r.package_access(d.packages, d.repo_packages, tenancy.visible_repos(d.repos, d.installations, d.users))


@query("atlas_nodes atlas_edges", f"""with {DEGREES}, lone as (select repo_id, 'orphan' as kind, path, row_number() over (partition by repo_id order by path) as place from deg where fan_in + fan_out = 0 and ext not in ('.md', '.json', '.yaml', '.yml', '.txt', '.toml', '.svg', '.png')),
    gaps as (select repo_id, 'unresolved' as kind, path, row_number() over (partition by repo_id order by path) as place from atlas_nodes where unresolved > 0) select * from lone where place <= 25 union all select * from gaps where place <= 20""")  # fmt: skip
def bounded_lists(d: Domain) -> DataFrame:
    return graph.bounded_lists(d.atlas_nodes, d.atlas_edges)


@query("repos", "select 'own' as kind, id::varchar as id, full_name as name from repos union all select * from (values ('benchmark', 'next-js', 'vercel/next.js'), ('benchmark', 'openai-python', 'openai/openai-python'), ('benchmark', 'stripe-node', 'stripe/stripe-node'), ('benchmark', 'fastapi', 'fastapi/fastapi')) as t(kind, id, name)")
def all_repositories(d: Domain) -> DataFrame:
    own = d.repos.select(F.lit("own").alias("kind"), F.col("id").cast("string").alias("id"), F.col("full_name").alias("name"))
    return own.unionByName(readers.benchmark_repos(d.spark).select(F.lit("benchmark").alias("kind"), "id", F.col("full_name").alias("name")))


@query("patches code_usages detected_changes", f"select p.id, case when {RISK} then 'risk' else 'plain' end as shown from patches p join code_usages u on u.id = p.code_usage_id join detected_changes c on c.id = u.detected_change_id")
def risk_filter(d: Domain) -> DataFrame:
    """Both client filters; a patch without a known change is in neither."""
    usage = d.code_usages.select(F.col("id").alias("code_usage_id"), F.col("detected_change_id").alias("change"))
    rows = d.patches.select("id", "code_usage_id").join(usage, "code_usage_id").join(d.detected_changes.select(F.col("id").alias("change"), r.semantic_risk().alias("risk")), "change", "left")
    return rows.where(F.col("risk").eqNullSafe(F.lit(True))).select("id", F.lit("risk").alias("shown")).union(rows.where(F.col("risk").eqNullSafe(F.lit(False))).select("id", F.lit("plain").alias("shown")))


@query("code_usages detected_changes", "select distinct repo_id, file_path, c.id from code_usages u join detected_changes c on c.id = u.detected_change_id")
def file_incidents(d: Domain) -> DataFrame:
    files = d.code_usages.groupBy("repo_id", "file_path").agg(F.collect_set("detected_change_id").alias("change_ids"))
    return r.file_incidents(d.detected_changes.select("id"), files)


@query("analysis_runs", "select repo_id, arg_max(id, (created_at, id)) as graph_id from analysis_runs where score % 4 > 0 group by repo_id")
def latest_ready_graph(d: Domain) -> DataFrame:
    return graph.latest_ready(d.analysis_runs.withColumn("status", F.expr("if(score % 4 > 0, 'ready', 'failed')")))


@query("atlas_nodes", "select repo_id, count(*) as files_checked, count(*) filter (unresolved > 0) as errors, coalesce(array_to_string(list_sort(list(path) filter (unresolved > 0)), ','), '') as failed, round_even(100.0::double * count(*) filter (unresolved = 0) / count(*), 1) as pass_rate from atlas_nodes group by repo_id")
def directory_verdicts(d: Domain) -> DataFrame:
    return local.directory_verdicts(d.atlas_nodes.select("repo_id", "path", (F.col("unresolved") == 0).alias("ok")), "repo_id")


@query(sql="""select doc_id, case when doc_id % 4 = 3 then null else substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) end as repo_id, case when doc_id % 2 = 0 then '{}' else lang end as payload from (select *, md5(doc_id::varchar) as h from documents)""")
def recorded_events(d: Domain) -> DataFrame:
    h = "md5(cast(doc_id as string))"
    spelled = f"case doc_id % 4 when 0 then {h} when 1 then upper({h}) when 2 then concat('{{', substr({h}, 1, 8), '-', substr({h}, 9), '}}') else 'not-an-id' end"
    return sinks.recorded_events(d.table("documents").selectExpr("doc_id", f"{spelled} as repo_id", "if(doc_id % 2 = 0, null, lang) as payload"))


@query("atlas_edges repos", "select repo_id, source_path, target_path from atlas_edges where repo_id not in (select id from repos where is_active) union all select distinct repo_id, 'new/' || source_path, target_path from atlas_edges where repo_id in (select id from repos where is_active)")
def graph_replace(d: Domain) -> DataFrame:
    active = d.repos.where("is_active").select(F.col("id").alias("repo_id"))
    built = d.atlas_edges.join(active, "repo_id", "left_semi").select("repo_id", F.concat(F.lit("new/"), "source_path").alias("source_path"), "target_path").distinct()
    return sinks.replaced_graphs(d.atlas_edges, built)


@query("detected_changes", "select 'enum change_type' as rule, change_type as value, count(*) as rows from detected_changes where change_type not in ('removed', 'renamed', 'signature_change', 'behavior_change', 'deprecated') group by change_type union all select 'enum source', 'web', count(*) from detected_changes where id % 3 = 0")
def violations(d: Domain) -> DataFrame:
    return sinks.violations(d.detected_changes.withColumn("source", F.when(F.col("id") % 3 == 0, "web").otherwise("npm_registry")), "detected_changes", ["id"])


ENDS = "('', '.ts', '.tsx', '.js', '.jsx', '.py', '.go', '.rs', '/index.ts', '/index.tsx', '/index.js')"


@query("atlas_nodes", f"""with added as (select repo_id, path from atlas_nodes where node % 3 = 0), specs as (select repo_id, path, 'n' || node // 2 || case when node % 2 = 0 then '' else '.py' end as name from atlas_nodes),
    ends as (select unnest({ENDS.replace('(', '[').replace(')', ']')}) as e) select distinct s.repo_id, s.path from specs s join added a on a.repo_id = s.repo_id join ends on a.path = name || e or ends_with(a.path, '/' || name || e)""")  # fmt: skip
def importers_of_added(d: Domain) -> DataFrame:
    nodes = d.atlas_nodes
    specs = nodes.select("repo_id", "path", F.expr("concat(if(node % 2 = 0, '@/', \"'\"), 'n', cast(node div 2 as string), if(node % 2 = 0, '', \".py'\"))").alias("spec"))
    return graph_updates.importers_of_added(specs, nodes.where("node % 3 = 0").select("repo_id", "path"))


@query("incident_events", "select id, event_type from incident_events where detected_change_id is null or detected_change_id = 15")
def live_events(d: Domain) -> DataFrame:
    return r.of_incident(d.incident_events, 15).select("id", "event_type")


@query("jobs", """select id, case job_type when 'poll_registry' then 'extract_changes' when 'scan_repo' then 'generate_patch' end as next_stage from jobs where status = 'done'""")
def next_stages(d: Domain) -> DataFrame:
    return scheduling.next_stages(d.jobs)


@query("jobs packages repo_packages repos", f"""select p.id from packages p where id in (select package_id from repo_packages u join repos q on q.id = u.repo_id where q.is_active) and not exists (select 1 from jobs j where j.package_id = p.id and job_type = 'poll_registry' and created_at > {NOW} - interval 15 minutes)""")
def due_polls(d: Domain) -> DataFrame:
    tracked = r.tracked_packages(d.packages, d.repo_packages, d.repos)
    return scheduling.due_polls(tracked, d.jobs, F.expr(NOW.replace("timestamp", "timestamp_ntz"))).select("id")


@query("atlas_nodes", "select repo_id, path, min(place) as place from (select repo_id, path, 1 as place from atlas_nodes where node % 5 = 0 union all select repo_id, path, 2 from atlas_nodes where node % 3 = 0 union all select repo_id, path, 3 from atlas_nodes where node % 2 = 0) group by all")
def reparse_order(d: Domain) -> DataFrame:
    return graph_updates.reparse_order(*(d.atlas_nodes.where(f"node % {n} = 0") for n in (5, 3, 2)))


@query()
def grounded_advice(d: Domain) -> DataFrame:
    from .queries import findings

    found = findings(d).groupBy("repo_id").agg(F.collect_list(F.struct("title", "why", "what", "link")).alias("findings"), F.collect_list("what").alias("advice"))
    invented = F.when(F.col("repo_id") % 2 == 0, F.array(F.lit("Break the import cycle in src/invented.ts"))).otherwise(F.array().cast("array<string>"))
    return lookup.grounded(found.select(F.col("repo_id").alias("id"), F.concat("advice", invented).alias("advice"), "findings", F.array().cast("array<string>").alias("packages")))


@query(sql="""select p_partkey as id, t.* from part join (values
    (0, 'node', 'pnpm', 'pnpm install --frozen-lockfile --ignore-scripts', 'pnpm test', 'pnpm run typecheck', true, true), (1, 'node', 'yarn', 'yarn install --frozen-lockfile --ignore-scripts', 'npm test', '', false, false),
    (2, 'node', 'npm', 'npm ci', 'npm test', 'npx tsc --noEmit', false, true), (3, 'python', 'pip', 'echo ' || chr(39) || 'Dependency installation skipped: allow_install_scripts is false (requires opt-in)' || chr(39), 'pytest', 'mypy .', true, true),
    (4, 'python', 'pip', 'pip install -r requirements.txt', 'pytest', '', true, false), (5, 'node', 'npm', 'npm ci --ignore-scripts', 'npm test', 'npx tsc --noEmit', true, true),
    (6, 'node', 'npm', 'npm ci --ignore-scripts', 'npm test', '', true, false))
    as t(kind, ecosystem, package_manager, install_cmd, test_cmd, typecheck_cmd, has_test, has_typecheck) on t.kind = p_partkey % 7""")  # fmt: skip
def environments(d: Domain) -> DataFrame:
    names = "case p_partkey % 7 when 0 then array('package.json', 'pnpm-lock.yaml', 'yarn.lock', 'tsconfig.base.json') when 1 then array('yarn.lock', 'package.json') when 2 then array('package.json', 'tsconfig.json', 'pyproject.toml') when 3 then array('pyproject.toml', 'mypy.ini') when 4 then array('requirements.txt') when 5 then array('README') else array(concat('file', p_size), 'package.json') end"
    package = """case p_partkey % 7 when 6 then concat('{"name":"', p_name, '","scripts":{"test":""}}') when 0 then '{"scripts":{"test":"vitest","typecheck":"tsc"}}' when 1 then '{}' when 2 then '{"scripts":{"test":"echo no test specified"}}' end"""
    rows = _part(d, kind="cast(p_partkey % 7 as int)", names=names, package=package, allowed="p_partkey % 7 in (2, 4)")
    return rows.select("id", "kind", text.environment(F.col("names"), F.col("package"), F.col("allowed")).alias("e")).select("id", "kind", "e.*")


@query(sql="select p_partkey as id, case p_partkey % 2 when 0 then 'Go,C,' || p_brand else 'Rust' end as languages from part")
def main_languages(d: Domain) -> DataFrame:
    return _part(d, answer="""if(p_partkey % 2 = 0, concat('{"Go":9,"C":8,"', p_brand, '":7,"D":1}'), '{"Rust":1}')""").select("id", F.array_join(readers.languages("answer"), ",").alias("languages"))


@query("repos", "select id, case when id % 2 = 0 then 'new ' || full_name else full_name end as full_name, id % 2 = 0 as is_active from repos union all select 1000000 + id, 'added', true from repos where id < 5")
def repo_sync(d: Domain) -> DataFrame:
    snapshot = d.repos.where("id % 2 = 0").select("id", F.concat(F.lit("new "), "full_name").alias("full_name")).union(d.repos.where("id < 5").select(F.col("id") + 1000000, F.lit("added")))
    return sinks.synced(d.repos.select("id", "full_name", "is_active"), snapshot)


@query(sql="select event_id from events where json_extract_string(props, '$.k') = '3'")
def json_equality(d: Domain) -> DataFrame:
    return d.table("events").where(F.get_json_object("props", "$.k") == "3").select("event_id")


@query("repos", "select id, coalesce(full_name, 'unknown') as full_name, is_active from repos where id = 7 union all select 7, 'unknown', false where not exists (select 1 from repos where id = 7)")
def repo_by_id(d: Domain) -> DataFrame:
    """A lookup by id, name or short name, with a made-up row where none fits."""
    return lookup.repo_lookup(d.repos, "7").select(F.col("id").cast("long").alias("id"), "full_name", "is_active")
