"""Queries of working copies, providers, pull request guards, queues and fallbacks, on inputs derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import SENTINEL
from ..operators import graph, local, repairs
from ..sources import readers, sinks
from ..streaming import stateful
from .bindings import Domain
from .queries import query

PLACE = "case when node % 8 = 0 then '.hidden/' when node % 8 = 1 then 'a/node_modules/' when node % 8 = 2 then 'out/' else '' end || path"
READ = "regexp_matches(path, '[.](ts|py)$')"


def _files(d: Domain) -> DataFrame:
    """A file for each node: some below folders that are left out, some that do not parse, some that call ``send``."""
    places = F.expr("concat(case when node % 8 = 0 then '.hidden/' when node % 8 = 1 then 'a/node_modules/' when node % 8 = 2 then 'out/' else '' end, path)")
    source = F.expr("""case when node % 11 = 0 then 'f((' when path like '%.py' then concat('import wire\\nwire.send(', node, ')\\n') else concat("import { send } from 'wire';\\nsend(", node, ");\\n") end""")
    return d.atlas_nodes.select("repo_id", places.alias("path"), source.alias("source"))


CALLED = f"called as (select repo_id, {PLACE} as path, case when path like '%.py' then 'wire.send(' || node || ')' else 'send(' || node || ')' end as snippet from atlas_nodes where node % 11 > 0 and node % 8 > 2 and {READ})"


def scanned(d: Domain) -> DataFrame:
    """Call sites by repository: its id goes in front of the path while files are scanned."""
    found = local.scan(_files(d).withColumn("path", F.concat_ws("/", F.col("repo_id").cast("string"), "path")), "send", "wire")
    return found.select(F.split("path", "/", 2)[0].cast("long").alias("repo_id"), F.split("path", "/", 2)[1].alias("path"), "line_start", "start_byte", "end_byte", "snippet")


@query("atlas_nodes repos", f"with {CALLED} select r.id as repo_id, count(c.path) as found, case when count(c.path) > 0 then 0 else 1 end as exit_code from repos r left join called c on c.repo_id = r.id group by r.id")
def scan_status(d: Domain) -> DataFrame:
    return local.scan_status(scanned(d), d.repos.select(F.col("id").alias("repo_id")), "repo_id")


@query("atlas_nodes", f"with {CALLED} select repo_id, n, '  ' || n || '. ' || path || ':2: ' || snippet as line from (select *, row_number() over (partition by repo_id order by path) as n from called)")
def scan_lines(d: Domain) -> DataFrame:
    return local.scan_lines(scanned(d), "repo_id")


@query("atlas_nodes repos", f"""with read as (select repo_id, {PLACE} as path, node % 11 > 0 as parses from atlas_nodes where node % 8 > 1 and {READ}), seen as (select repo_id, count(*) as files_checked, count(*) filter (not parses) as parse_errors, min(path) filter (not parses) as first_error from read group by repo_id),
    o as (select id as repo_id, case when id % 3 = 0 then id % 5 > 0 end as types, case when id % 4 > 0 then id % 7 > 0 end as tests from repos), j as (select repo_id, coalesce(files_checked, 0) as files_checked, coalesce(parse_errors, 0) as parse_errors, first_error, types, tests from o left join seen using (repo_id))
    select *, parse_errors = 0 and types is not false and tests is not false as all_passed, case when parse_errors = 0 and types is not false and tests is not false then 0 else 1 end as exit_code from j""")  # fmt: skip
def verify_receipts(d: Domain) -> DataFrame:
    outcomes = d.repos.selectExpr("id as repo_id", "if(id % 3 = 0, id % 5 > 0, null) as types", "if(id % 4 > 0, id % 7 > 0, null) as tests")
    return local.receipts(_files(d), outcomes, "repo_id")


@query(sql="""with p as (select p_partkey as id, p_partkey % 9 as k, p_name as n, '2.' || p_size as v from part) select id, case k when 0 then 'log ' || n when 4 then 'readme ' || n when 7 then 'text ' || n end as notes,
    case k when 1 then 'Failed to fetch npm metadata for package ''' || n || '''' when 2 then 'Version ''' || v || ''' not found in npm versions for package ''' || n || '''' when 3 then 'No usable README text available for ' || n || ' (' || v || ') in npm packument'
    when 5 then 'Failed to fetch PyPI metadata for package ''' || n || ''' at version ''' || v || '''' when 6 then 'No changelog or release text available for ' || n || ' (1.0 -> ' || v || ')' when 8 then 'No changelog or release text available for ' || n || ' (1.0 -> ' || v || ')' end as _error from p""")  # fmt: skip
def release_texts(d: Domain) -> DataFrame:
    versions = """concat('{"versions":{"2.', p_size, '":{}},"readme":"', if(p_partkey % 9 = 3, '  ', concat('readme ', p_name)), '"}')"""
    rows = d.table("part").selectExpr(
        "p_partkey as id", "p_name as name", "case when p_partkey % 9 in (5, 6, 7) then 'pypi' when p_partkey % 9 = 8 then 'cargo' else 'npm' end as ecosystem", "'1.0' as old_version", "concat('2.', p_size) as version",
        f"""case p_partkey % 9 when 1 then null when 2 then '{{"versions":{{"0.1":{{}}}},"readme":"x"}}' when 5 then '{{}}' when 6 then '{{"info":{{"description":""}}}}' when 7 then concat('{{"info":{{"description":"text ', p_name, '"}}}}') else {versions} end as json""",
        "if(p_partkey % 9 = 0, concat('log ', p_name), '') as changelog",
    )
    return local.release_texts(rows).select("id", "notes", "_error")


@query(sql=f"""select p_partkey as id, case when p_partkey % 5 in (0, 1) then '--- a/src/a.ts' || chr(10) || '+++ b/src/a.ts' || chr(10) || '@@ -' || p_size || ',2 +' || p_size || ',2 @@' || chr(10) || '-x = old' || p_partkey || '(1)' || chr(10) || '-y = older(old' || p_partkey || ')' || chr(10)
    || '+x = new$' || p_partkey || '(1)' || chr(10) || '+y = older(new$' || p_partkey || ')' || chr(10) else '{SENTINEL}' end as diff from part""")  # fmt: skip
def rename_patches(d: Domain) -> DataFrame:
    rows = d.table("part").selectExpr(
        "p_partkey as id", "'src/a.ts' as path", "p_size as line_start", "concat('x = old', p_partkey, '(1)\\ny = older(old', p_partkey, ')') as snippet",
        "case p_partkey % 5 when 2 then 'ol' when 3 then 'old (x)' else concat('old', p_partkey) end as symbol", "if(p_partkey % 5 = 4, null, concat('new$', p_partkey)) as symbol_new",
    )
    return repairs.patched(rows).select("id", "diff")


@query("code_usages pull_requests", """with held as (select distinct repo_id, id % 5 as version_id from pull_requests where status = 'open' and id % 3 = 0), q as (select id, repo_id, case when id % 6 > 0 then id % 10 end as version_id from code_usages)
    select q.id, case when h.repo_id is not null then 'duplicate' when id % 4 = 0 and id % 16 > 0 then 'drifted' when id % 4 = 1 and id % 3 = 0 then 'drifted' else 'open' end as decision from q left join held h on h.repo_id = q.repo_id and h.version_id = q.version_id""")  # fmt: skip
def pr_decisions(d: Domain) -> DataFrame:
    requests = d.code_usages.selectExpr(
        "id", "repo_id", "if(id % 6 > 0, id % 10, null) as version_id", "case when id % 4 = 0 then if(id % 16 > 0, 'bb', 'aa') else '' end as asked_base",
        "if(id % 4 = 1, concat('[base_sha:', if(id % 3 = 0, 'cc', 'aa'), '] done'), 'done') as log", "'aa' as head",
    )
    prs = d.pull_requests.selectExpr("repo_id", "if(id % 3 = 0, id % 5, null) as version_id", "status")
    return repairs.pr_decisions(requests, prs).select("id", "decision")


@query("atlas_nodes atlas_edges", """with known as (select repo_id, source_path, target_path from atlas_edges where repo_id % 3 = 0 union all select repo_id, source_path, target_path from atlas_edges where repo_id % 3 > 0 and repo_id % 2 = 0),
    e as (select repo_id, source_path as path, target_path as t, null as s from known union all select repo_id, target_path, null, source_path from known) select n.repo_id, n.path, coalesce(array_to_string(list_sort(list(distinct t) filter (t is not null)), ','), '') as imports,
    coalesce(array_to_string(list_sort(list(distinct s) filter (s is not null)), ','), '') as imported_by from (select distinct repo_id, path from atlas_nodes) n left join e on e.repo_id = n.repo_id and e.path = n.path group by n.repo_id, n.path""")  # fmt: skip
def neighbors_fallback(d: Domain) -> DataFrame:
    """A third of the repositories have edges as rows; half of the others have them in a document only, under no state."""
    asked = d.atlas_nodes.select("repo_id", F.expr("if(node % 2 = 0, concat('/', path), translate(path, '/', '\\\\'))").alias("path"))
    listed = d.atlas_edges.groupBy("repo_id").agg(F.collect_list(F.struct(F.col("source_path").alias("source"), F.col("target_path").alias("target"))).alias("edges"))
    documents = listed.select("repo_id", F.lit(1).alias("id"), F.lit("ready").alias("status"), F.lit(2).alias("created_at"), "edges").union(listed.select("repo_id", F.lit(2), F.lit("failed"), F.lit(3), F.slice("edges", 1, 1))).union(listed.select("repo_id", F.lit(3), F.lit("ready"), F.lit(1), F.slice("edges", 1, 1)))
    return graph.neighbors_of(asked, d.atlas_edges.where("repo_id % 3 = 0"), d.repos.where("id % 3 = 0 or id % 2 = 1").select(F.col("id").alias("repo_id")), documents)


@query("repos code_usages patches validation_runs pull_requests", """with r as (select id from repos where id % 3 > 0), u as (select id from code_usages where repo_id in (select id from r)), p as (select id from patches where code_usage_id in (select id from u))
    select 'repos' as name, count(*) as rows from r union all select 'code_usages', count(*) from u union all select 'patches', count(*) from p union all select 'validation_runs', count(*) from validation_runs where patch_id in (select id from p) union all select 'pull_requests', count(*) from pull_requests where repo_id in (select id from r)""")  # fmt: skip
def cascade_delete(d: Domain) -> DataFrame:
    tables = {"repos": d.repos.where("id % 3 > 0"), "code_usages": d.code_usages, "patches": d.patches, "validation_runs": d.validation_runs, "pull_requests": d.pull_requests}
    left = sinks.cascaded(tables, [("code_usages", "repo_id", "repos"), ("pull_requests", "repo_id", "repos"), ("patches", "code_usage_id", "code_usages"), ("validation_runs", "patch_id", "patches")])
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, rows in left.items()]
    out = counts[0]
    for rows in counts[1:]:
        out = out.union(rows)
    return out


@query("incident_events repos", """with s as (select id as subscriber, case when id % 4 > 0 then id end as repo_id from repos), q as (select id, repo_id, row_number() over (partition by repo_id order by created_at desc, id desc) as own, row_number() over (order by created_at desc, id desc) as every from incident_events)
    select subscriber, id from s join q using (repo_id) where own <= 25 union all select subscriber, id from s, q where s.repo_id is null and every <= 25""")  # fmt: skip
def subscriber_queues(d: Domain) -> DataFrame:
    return stateful.queues(d.incident_events, d.repos.selectExpr("id as subscriber", "if(id % 4 > 0, id, null) as repo_id"), n=25)


@query(sql="""select event_id as id, case event_id % 4 when 0 then '10.0.0.' || user_id when 1 then '10.1.1.' || user_id else 'unknown' end as client from events where event_type <> 'view' and event_id % 6 > 0""")
def limited_requests(d: Domain) -> DataFrame:
    rows = d.table("events").selectExpr(
        "event_id as id", "if(event_type = 'view', 'OPTIONS', 'GET') as method", "if(event_id % 6 = 0, if(event_id % 12 = 0, '/webhooks/x', '/api/health'), '/api/healthy') as path",
        "case event_id % 4 when 0 then concat(' , 10.0.0.', user_id, ', 10.9.9.9') when 2 then ' ,' end as forwarded", "if(event_id % 4 = 1, concat('10.1.1.', user_id), null) as address",
    )
    return rows.where(~stateful.exempt("method", "path")).select("id", stateful.client_of("forwarded", "address", True).alias("client"))


@query(sql="select event_id as id, timestamp '2024-01-15 00:00:00' + to_milliseconds(event_id * 37 % 90000) as at from events")
def timeline(d: Domain) -> DataFrame:
    run = d.table("events").selectExpr("event_id as id", "cast(event_id * 37 % 90000 as int) as offset_ms")
    return readers.timeline(run, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
