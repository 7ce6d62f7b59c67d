"""Registered queries over the domain views, each with its DuckDB statement where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import graph, lookup, reporting as r, scheduling, scoring, tenancy
from ..sources import sinks
from ..streaming import stateful
from .bindings import Domain, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "timestamp '2024-01-15 00:00:00'"


def query(views: str = "", sql: str | None = None, name: str | None = None):
    """Registers a function of a ``Domain``; ``views`` are those that its statement reads."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf_dir: function(Domain(spark, sf_dir))
        if sql and not views:
            ORACLES[key] = sql
        elif sql:
            own, head = sql.lstrip(), with_clause(*views.split())
            if own.startswith("with recursive "):
                ORACLES[key] = head.replace("with ", "with recursive ", 1) + ", " + own[len("with recursive ") :]
            else:
                ORACLES[key] = head + ", " + own[5:] if own.startswith("with ") else head + sql
        return function

    return add


RISK = "coalesce(change_type = 'behavior_change' or (change_type in ('signature_change', 'deprecated') and confidence < 0.75), false)"
MECH = "coalesce(change_type in ('removed', 'renamed') or (change_type in ('signature_change', 'deprecated') and confidence >= 0.75), false)"
LAST_RUN = "last_run as (select * from (select *, row_number() over (partition by patch_id order by created_at desc, tie desc, tie2 desc, tie3 desc) as rn from validation_runs) where rn = 1)"
SCOPE = """select distinct u.id as user_id, p.id as repo_id from repos p join installations i on p.installation_id = i.id
    join users u on i.installed_by = u.id or lower(i.account_login) = lower(u.login)"""


@query("repos installations users", SCOPE)
def tenant_scope(d: Domain) -> DataFrame:
    return tenancy.visible_repos(d.repos, d.installations, d.users)


@query("repos installations users", f"with scope as ({SCOPE}), asked as (select distinct event_id % 5 as user_id, user_id as repo_id from events) "
    "select a.user_id, a.repo_id, case when p.id is null then 404 when s.repo_id is null then 403 else 200 end as outcome from asked a left join repos p on p.id = a.repo_id left join scope s on s.user_id = a.user_id and s.repo_id = a.repo_id")  # fmt: skip
def access_outcome(d: Domain) -> DataFrame:
    asked = d.table("events").select((F.col("event_id") % 5).alias("user_id"), F.col("user_id").alias("repo_id")).distinct()
    return tenancy.access_outcome(asked, d.repos, tenancy.visible_repos(d.repos, d.installations, d.users))


@query("repos pull_requests code_usages patches", """select *, coalesce(round_even(prs_merged / nullif(prs_opened, 0)::double, 3), 0.0) as merge_rate from
    (select count(*) filter (is_active) as active_repos from repos), (select count(*) as prs_opened, count(*) filter (merged or status = 'merged') as prs_merged from pull_requests),
    (select count(*) as patches, count(*) filter (verified) as verified_patches from patches where code_usage_id in (select id from code_usages))""")  # fmt: skip
def stats_summary(d: Domain) -> DataFrame:
    return r.stats_summary(d.repos, d.pull_requests, d.code_usages, d.patches)


@query("repos detected_changes pull_requests code_usages patches", """select * from (select count(*) as repos_watched from repos), (select count(*) as changes_detected from detected_changes),
    (select count(*) as usages_found from code_usages), (select count(*) as patches_generated, count(*) filter (verified) as patches_verified from patches),
    (select count(*) as prs_opened, count(*) filter (merged or status = 'merged') as prs_merged from pull_requests)""")  # fmt: skip
def funnel_metrics(d: Domain) -> DataFrame:
    return r.funnel_metrics(d.repos, d.detected_changes, d.code_usages, d.patches, d.pull_requests)


RECENT = "select c.id, u.id as usage_id, change_type, confidence, c.created_at from detected_changes c join code_usages u on u.detected_change_id = c.id {} order by c.created_at desc, c.id desc, u.id desc limit 5"
for _name, _sql, _keep in (("recent_changes", "", None), ("recent_changes_semantic", f"where {RISK}", r.semantic_risk), ("recent_changes_mechanical", f"where {MECH}", r.mechanical)):
    query("detected_changes code_usages", RECENT.format(_sql), _name)(lambda d, keep=_keep: r.recent_changes(d.detected_changes, d.code_usages, keep() if keep else None))


@query("pull_requests patches code_usages validation_runs detected_changes", f"""with {LAST_RUN},
    pull as (select 'pull_request' as kind, id, opened_at as happened_at, repo_id, merged as flag from pull_requests order by happened_at desc, id desc limit 20),
    patch as (select 'patch' as kind, p.id, p.created_at as happened_at, u.repo_id from patches p join code_usages u on u.id = p.code_usage_id order by happened_at desc, p.id desc limit 20),
    change as (select 'change' as kind, u.id, u.created_at as happened_at, u.repo_id, null::boolean as flag from code_usages u join detected_changes c on c.id = u.detected_change_id order by happened_at desc, u.id desc limit 20)
    select * from (select * from pull union all select kind, id, happened_at, repo_id, tests_pass from patch left join last_run on patch_id = id union all select * from change) order by happened_at desc nulls last, kind, id desc limit 50""")  # fmt: skip
def activity_feed(d: Domain) -> DataFrame:
    return r.activity_feed(d.pull_requests, d.patches, d.code_usages, d.validation_runs, d.detected_changes)


PATCH_ORDER = {
    "default": ("created_at desc, id desc", "created_at desc, id desc"),
    "risk_first": ("is_semantic_risk desc nulls first, created_at desc, id desc", "coalesce(is_semantic_risk, false) desc, created_at desc, id desc"),
    "confidence_asc": ("confidence asc nulls last, created_at desc, id desc", "coalesce(confidence, 1.0) asc, created_at desc, id desc"),
    "confidence_desc": ("confidence desc nulls first, created_at desc, id desc", "coalesce(confidence, 0.0) desc, created_at desc, id desc"),
}
for _order, (_first, _second) in PATCH_ORDER.items():
    query("patches code_usages detected_changes", f"""with base as (select p.id, u.repo_id, verified, {RISK} as is_semantic_risk, confidence, p.created_at from patches p join code_usages u on u.id = p.code_usage_id
        left join detected_changes c on c.id = u.detected_change_id), page as (select * from base order by {_first} limit 20)
        select row_number() over (order by {_second}) as position, id, repo_id, verified, is_semantic_risk, confidence from page""", f"patches_{_order}")(lambda d, order=_order: r.patch_list(d.patches, d.code_usages, d.detected_changes, order))  # fmt: skip


@query("patches code_usages detected_changes", f"""with base as (select p.id, u.repo_id, confidence, p.created_at from patches p join code_usages u on u.id = p.code_usage_id join detected_changes c on c.id = u.detected_change_id where verified and {RISK})
    select id, repo_id, confidence, (select count(*) from base) as total from base order by created_at desc, id desc limit 20 offset 20""")  # fmt: skip
def review_digest_page(d: Domain) -> DataFrame:
    return r.review_digest(d.patches, d.code_usages, d.detected_changes)


@query("repos pull_requests", "select p.id, full_name, count(q.id) as pr_count from repos p left join pull_requests q on q.repo_id = p.id group by all")
def repo_pr_counts(d: Domain) -> DataFrame:
    return r.repo_pr_counts(d.repos, d.pull_requests)


@query("code_usages detected_changes packages", "select distinct u.repo_id, c.id, coalesce(p.name, 'unknown') as package_name, change_type from detected_changes c left join packages p on p.id = c.package_id join code_usages u on u.detected_change_id = c.id where u.status <> 'patched'")
def active_incidents(d: Domain) -> DataFrame:
    return r.active_incidents(d.code_usages, d.detected_changes, d.packages)


BEST = "best as (select * from (select *, row_number() over (partition by code_usage_id order by verified desc, created_at, id) as rn from patches) where rn = 1)"


@query("code_usages patches validation_runs pr_patches pull_requests", f"""with {LAST_RUN}, {BEST},
    pulls as (select * from (select patch_id, pr_id, q.status as pr_status, row_number() over (partition by patch_id order by opened_at desc, pr_id desc) as rn from pr_patches join pull_requests q on q.id = pr_id) where rn = 1)
    select u.id, u.repo_id, u.detected_change_id, u.status, b.id as patch_id, verified, tests_pass, typechecks, pr_id, pr_status from code_usages u
    left join best b on b.code_usage_id = u.id left join last_run l on l.patch_id = b.id left join pulls on pulls.patch_id = b.id""")  # fmt: skip
def incident_snapshot(d: Domain) -> DataFrame:
    return r.incident_snapshot(d.code_usages, d.patches, d.validation_runs, d.pr_patches, d.pull_requests)


@query("incident_events code_usages", """select e.id, e.repo_id, e.event_type, e.created_at from incident_events e left join code_usages u on u.id = e.code_usage_id
    where (e.detected_change_id = 15 or u.detected_change_id = 15) and e.created_at > timestamp '2024-01-03' order by e.created_at, e.id limit 500""")  # fmt: skip
def incident_history(d: Domain) -> DataFrame:
    return r.incident_history(d.incident_events, d.code_usages, 15, "2024-01-03")


@query("code_usages", "select repo_id, file_path, array_to_string(list_sort(list(distinct detected_change_id)), ',') as change_ids from code_usages where status <> 'patched' group by all")
def breakages_by_file(d: Domain) -> DataFrame:
    return r.breakages_by_file(d.code_usages)


@query("validation_runs", f"with {LAST_RUN} select patch_id, tests_pass, typechecks, created_at from last_run")
def latest_validation(d: Domain) -> DataFrame:
    return r.latest_runs(d.validation_runs).select("patch_id", "tests_pass", "typechecks", "created_at")


@query("patches", f"with {BEST} select code_usage_id, id, verified from best")
def best_patch(d: Domain) -> DataFrame:
    return r.best_patches(d.patches).select("code_usage_id", "id", "verified")


@query("analysis_runs", "select id, repo_id, score, coalesce(score - lag(score) over (partition by repo_id order by created_at, id), 0) as delta from analysis_runs")
def run_delta(d: Domain) -> DataFrame:
    return r.run_deltas(d.analysis_runs)


@query("jobs", "select id, package_id, version, coalesce(lag(version) over (partition by package_id order by locked_at nulls first, id), 'none') as old_version from jobs")
def previous_version(d: Domain) -> DataFrame:
    return r.previous_version(d.jobs.withColumn("published_at", F.col("locked_at")), ["package_id"]).select("id", "package_id", "version", "old_version")


TRI = "case when count(*) filter (l.patch_id is null) > 0 then null when count(*) filter ({0} = false) > 0 then false when count(*) filter ({0} is null) > 0 then null else true end"


@query("pr_patches patches validation_runs code_usages detected_changes", f"""with {LAST_RUN}, rolled as (select pr_id, bool_or(coalesce({RISK}, true)) as is_semantic_risk, min(confidence) as confidence,
    array_to_string(list_sort(list(distinct change_type)), ', ') as change_types, {TRI.format('tests_pass')} as tests_passed, {TRI.format('typechecks')} as types_passed
    from pr_patches q join patches p on p.id = q.patch_id join code_usages u on u.id = p.code_usage_id left join detected_changes c on c.id = u.detected_change_id left join last_run l on l.patch_id = q.patch_id group by pr_id)
    select *, not coalesce(tests_passed, false) or not coalesce(types_passed, false) or is_semantic_risk or not false as needs_review from rolled""")  # fmt: skip
def verdict_rollup(d: Domain) -> DataFrame:
    return r.verdict_rollup(d.pr_patches, d.patches, d.validation_runs, d.code_usages, d.detected_changes)


@query("pr_patches validation_runs", f"""with {LAST_RUN}, listed as (select * from pr_patches union all select o_orderkey, o_orderkey * 10 + 9 from orders where o_orderstatus = 'P'), judged as (select pr_id, l.patch_id is null as missing,
    applies_cleanly is not true or parses is not true or scope_ok is not true or tests_pass is false or typechecks is false as bad from listed q left join last_run l on l.patch_id = q.patch_id)
    select pr_id, case when count(*) filter (bad and not missing) > 0 then 'failure' when count(*) filter (missing) > 0 then 'neutral' else 'success' end as conclusion from judged group by pr_id""")  # fmt: skip
def check_run_conclusion(d: Domain) -> DataFrame:
    # patch 9 of an order in progress has no run yet
    unchecked = d.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("pr_id"), (F.col("o_orderkey") * 10 + 9).alias("patch_id"))
    return r.check_conclusion(d.pr_patches.union(unchecked), d.validation_runs)


@query("validation_runs", "select patch_id, tie, tie2, not coalesce(tests_pass, false) or not coalesce(typechecks, false) or patch_id % 2 = 0 or not (patch_id % 3 = 0) as needs_review from validation_runs")
def human_review_gate(d: Domain) -> DataFrame:
    rows = d.validation_runs.withColumn("risk", F.col("patch_id") % 2 == 0)
    return rows.select("patch_id", "tie", "tie2", r.needs_review("tests_pass", "typechecks", "risk", F.col("patch_id") % 3 == 0).alias("needs_review"))


@query("packages repo_packages repos", "select * from packages where id in (select package_id from repo_packages u join repos p on p.id = u.repo_id where p.is_active)")
def tracked_packages(d: Domain) -> DataFrame:
    return r.tracked_packages(d.packages, d.repo_packages, d.repos)


@query("pull_requests pr_patches patches", "select id as patch_id from patches where id not in (select patch_id from pr_patches join pull_requests q on q.id = pr_id where q.status = 'open')")
def open_pr_guard(d: Domain) -> DataFrame:
    return r.open_pr_guard(d.pull_requests, d.pr_patches, d.patches)


DEGREES = """deg as (select n.*, coalesce(fan_in, 0) as fan_in, coalesce(fan_out, 0) as fan_out from atlas_nodes n
    left join (select repo_id, target_path as path, count(*) as fan_in from atlas_edges group by all) i using (repo_id, path)
    left join (select repo_id, source_path as path, count(*) as fan_out from atlas_edges group by all) o using (repo_id, path))"""
FOLDER = "case when {0} like '%/%' then regexp_replace({0}, '/[^/]*$', '') else '' end"


@query("atlas_nodes atlas_edges", f"with {DEGREES} select repo_id, path, fan_in, fan_out from deg")
def fan_in_out(d: Domain) -> DataFrame:
    return graph.degrees(d.atlas_nodes, d.atlas_edges).select("repo_id", "path", "fan_in", "fan_out")


@query("atlas_nodes atlas_edges", f"with {DEGREES} select * from (select repo_id, row_number() over (partition by repo_id order by fan_in desc, path) as rank, path, fan_in, fan_out, fan_in > 30 as critical from deg where fan_in > 0) where rank <= 10")
def hub_files(d: Domain) -> DataFrame:
    return graph.hubs(d.atlas_nodes, d.atlas_edges)


@query("atlas_nodes atlas_edges", f"with {DEGREES} select repo_id, path from deg where fan_in + fan_out = 0 and ext not in ('.md', '.json', '.yaml', '.yml', '.txt', '.toml', '.svg', '.png')")
def orphans(d: Domain) -> DataFrame:
    return graph.orphans(d.atlas_nodes, d.atlas_edges)


@query("atlas_edges", f"with f as (select repo_id, {FOLDER.format('source_path')} <> {FOLDER.format('target_path')} as cross_ from atlas_edges) select repo_id, count(*) as edge_count, count(*) filter (cross_) as cross_folder, round_even(count(*) filter (cross_) / count(*)::double, 3) as coupling_ratio from f group by repo_id")
def coupling(d: Domain) -> DataFrame:
    return graph.coupling(d.atlas_edges)


@query("atlas_nodes", "select repo_id, sum(unresolved)::bigint as unresolved_count, count(*) filter (unresolved > 0) as files from atlas_nodes group by repo_id")
def unresolved_summary(d: Domain) -> DataFrame:
    return d.atlas_nodes.groupBy("repo_id").agg(F.sum("unresolved").cast("long").alias("unresolved_count"), F.count_if(F.col("unresolved") > 0).alias("files"))


@query("atlas_edges", """with e as (select repo_id, source_path as path, target_path as t, null as s from atlas_edges union all select repo_id, target_path, null, source_path from atlas_edges)
    select repo_id, path, coalesce(array_to_string(list_sort(list(distinct t) filter (t is not null)), ','), '') as imports, coalesce(array_to_string(list_sort(list(distinct s) filter (s is not null)), ','), '') as imported_by from e group by repo_id, path""")  # fmt: skip
def neighbors(d: Domain) -> DataFrame:
    return graph.neighbors(d.atlas_edges)


@query("atlas_nodes", f"""with recursive_f as (select distinct repo_id, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) as folder from atlas_nodes)
    select distinct repo_id, folder, case when folder = '' then null else {FOLDER.format('folder')} end as parent, case when folder = '' then 0 else len(string_split(folder, '/')) end as depth from recursive_f""")  # fmt: skip
def folder_closure(d: Domain) -> DataFrame:
    return graph.folder_closure(d.atlas_nodes)


@query("atlas_nodes", f"""with f as (select distinct repo_id, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) as folder from atlas_nodes),
    c as (select repo_id, folder, case when folder = '' then null else {FOLDER.format('folder')} end as parent, case when folder = '' then 0 else len(string_split(folder, '/')) end as depth from f),
    s as (select *, row_number() over (partition by repo_id, parent order by folder) - 1 as rank, count(*) over (partition by repo_id, parent) as siblings from c),
    o as (select *, case when parent is null then 0 else (4.8 + 0.85 * siblings) end::double as radius from s)
    select s.repo_id, s.folder, any_value(s.rank) as rank, any_value(s.siblings) as siblings, round(sum(o.radius * cos(2 * pi() * o.rank / o.siblings)), 5) as x, round(-4.8 * any_value(s.depth), 5)::double as y,
    round(sum(o.radius * sin(2 * pi() * o.rank / o.siblings)), 5) as z from s join o on o.repo_id = s.repo_id and (s.folder = o.folder or (o.folder <> '' and starts_with(s.folder, o.folder || '/'))) group by s.repo_id, s.folder""")  # fmt: skip
def layout_anchors(d: Domain) -> DataFrame:
    return graph.layout_anchors(graph.folder_closure(d.atlas_nodes))


@query("atlas_nodes atlas_edges", """with recursive walk as (select repo_id, path, 0 as hops from atlas_nodes where node % 97 = 0 union select e.repo_id, e.source_path, hops + 1 from walk w join atlas_edges e on e.repo_id = w.repo_id and e.target_path = w.path where hops < 3)
    select repo_id, path, min(hops) as hops from walk group by all""".replace("with recursive", "with"))  # fmt: skip
def blast_radius(d: Domain) -> DataFrame:
    return graph.blast_radius(d.atlas_edges, d.atlas_nodes.where("node % 97 = 0"))


ORACLES["blast_radius"] = ORACLES["blast_radius"].replace("with ", "with recursive ", 1)
REACH = "reach as (select repo_id, source_path as a, target_path as b from atlas_edges union select r.repo_id, r.a, e.target_path from reach r join atlas_edges e on e.repo_id = r.repo_id and e.source_path = r.b)"


@query("atlas_edges", f"with {REACH}, inside as (select repo_id, a, min(b) as least from (select x.repo_id, x.a, x.b from reach x join reach y on x.repo_id = y.repo_id and x.a = y.b and x.b = y.a) group by all) select repo_id, count(distinct least) as cycles_count, array_to_string(list_sort(list(distinct a)), ',') as cycle_nodes from inside group by repo_id")
def scc_count(d: Domain) -> DataFrame:
    return graph.cycles_and_chains(d.atlas_edges).where("cycles_count > 0").select("repo_id", "cycles_count", "cycle_nodes")


ORACLES["scc_count"] = ORACLES["scc_count"].replace("with ", "with recursive ", 1)


@query("atlas_links atlas_nodes", """with e as (select distinct a.repo_id, src, tgt from atlas_links join atlas_nodes a on a.node = src where tgt > src),
    walk as (select repo_id, tgt as at, 2 as depth from e union select w.repo_id, e.tgt, depth + 1 from walk w join e on e.repo_id = w.repo_id and e.src = w.at) select repo_id, max(depth)::bigint as chain_depth from walk group by repo_id""")  # fmt: skip
def longest_chain(d: Domain) -> DataFrame:
    links = d.atlas_links.where("tgt > src").join(d.atlas_nodes.select("repo_id", F.col("node").alias("src")), "src")
    rows = graph.cycles_and_chains(links.select("repo_id", F.col("src").cast("string").alias("source_path"), F.col("tgt").cast("string").alias("target_path")))
    return rows.select("repo_id", "chain_depth")


ORACLES["longest_chain"] = ORACLES["longest_chain"].replace("with ", "with recursive ", 1)


def _signals(d: Domain) -> DataFrame:
    nodes, edges = d.atlas_nodes, d.atlas_edges
    return scoring.signals(d.repos, nodes, edges, graph.degrees(nodes, edges), graph.cycles_and_chains(edges), d.code_usages, d.detected_changes, d.pull_requests, d.patches, d.validation_runs, graph.PASSIVE_EXTENSIONS)


SIGNAL_VIEWS = "repos atlas_nodes atlas_edges code_usages detected_changes pull_requests patches validation_runs"
CLAMP = "greatest(0, least(100, round_even({}, 0)))::int"
SIGNALS = f"""{REACH}, inside as (select repo_id, a, min(b) as least from (select x.repo_id, x.a, x.b from reach x join reach y on x.repo_id = y.repo_id and x.a = y.b and x.b = y.a) group by all),
    cyc as (select repo_id, count(distinct least) as cycles_count, list_sort(list(distinct a) filter (least = first_)) as sample from (select *, min(least) over (partition by repo_id) as first_ from inside) group by repo_id), {DEGREES},
    shape as (select repo_id, count(*) as node_count, least(10, count(*) filter (fan_in > 30)) as critical_hubs, max(fan_in) as max_fan_in, arg_min(path, (-fan_in, path)) as hub_path, arg_min(fan_out, (-fan_in, path)) as hub_out, min(path) filter (unresolved > 0) as gap_path, arg_min(unresolved, path) filter (unresolved > 0) as gap_n, count(*) filter (fan_in + fan_out = 0 and ext not in ('.md', '.json')) as orphans_count,
        sum(unresolved) as unresolved_count, bool_or(lower(path) like '%test%' or lower(path) like '%spec%') as has_tests, false as has_ci from deg group by repo_id),
    dep as (select u.repo_id, count(*) as breaking_count, count(distinct string_split(description, ' ')[1]) as total_dependencies, list_sort(list(distinct string_split(description, ' ')[1])) as breaking_packages from code_usages u join detected_changes c on c.id = u.detected_change_id where status = 'pending' group by u.repo_id),
    pulls as (select repo_id, count(*) as total_prs, count(*) filter (merged or status = 'merged') as merged_prs, count(*) filter (status = 'open') as open_prs from pull_requests group by repo_id),
    tested as (select u.repo_id, round_even(count(*) filter (tests_pass) / count(*)::double, 3) as pass_rate from validation_runs v join patches p on p.id = v.patch_id join code_usages u on u.id = p.code_usage_id where tests_pass is not null group by u.repo_id),
    sig as (select r.id as repo_id, full_name, coalesce(node_count, 0) as node_count, coalesce(critical_hubs, 0) as critical_hubs, coalesce(max_fan_in, 0) as max_fan_in, coalesce(orphans_count, 0) as orphans_count, coalesce(unresolved_count, 0) as unresolved_count,
        coalesce(has_tests, false) as has_tests, coalesce(has_ci, false) as has_ci, coalesce(breaking_count, 0) as breaking_count, coalesce(total_dependencies, 0) as total_dependencies, coalesce(total_prs, 0) as total_prs,
        coalesce(open_prs, 0) as open_prs, coalesce(cycles_count, 0) as cycles_count, sample, hub_path, hub_out, gap_path, gap_n, breaking_packages, pass_rate, round_even(coalesce(orphans_count, 0) / greatest(1, coalesce(node_count, 0))::double, 3) as orphan_ratio, round_even(merged_prs / total_prs::double, 3) as merge_rate
        from repos r left join shape s on s.repo_id = r.id left join dep on dep.repo_id = r.id left join pulls on pulls.repo_id = r.id left join tested on tested.repo_id = r.id left join cyc on cyc.repo_id = r.id),
    sc as (select *, case when node_count > 0 then {CLAMP.format("90.0 - least(50.0, cycles_count * 10.0) - critical_hubs * 5.0 - (orphan_ratio / 0.10) * 3.0 + case when unresolved_count > 0 then 0 else 10.0 end")} end as structure,
        case when total_dependencies > 0 or breaking_count > 0 then {CLAMP.format("100.0 - breaking_count * 20.0")} end as dependency,
        {CLAMP.format("100.0 - case when has_tests then 0 else 15.0 end - case when has_ci then 0 else 10.0 end - critical_hubs * 5.0")} as change_safety,
        case when total_prs > 0 or merge_rate is not null or pass_rate is not null then {CLAMP.format("70.0 + case when merge_rate > 0.8 then 20 else 0 end + case when pass_rate > 0.9 then 15 else 0 end - case when open_prs > 3 then 10 else 0 end")} end as verification from sig),
    fin as (select *, case when w > 0 then greatest(0, least(100, round_even(t / w, 0)))::int else 75 end as score from (select *, coalesce(structure * 0.30::double, 0) + coalesce(dependency * 0.30::double, 0) + coalesce(change_safety * 0.25::double, 0) + coalesce(verification * 0.15::double, 0) as t,
        case when structure is not null then 0.30::double else 0 end + case when dependency is not null then 0.30::double else 0 end + case when change_safety is not null then 0.25::double else 0 end + case when verification is not null then 0.15::double else 0 end as w from sc))"""
SCORES = {
    "structure_score": ["repo_id", "cycles_count", "critical_hubs", "orphan_ratio", "structure"],
    "dependency_score": ["repo_id", "breaking_count", "total_dependencies", "dependency"],
    "safety_score": ["repo_id", "has_tests", "has_ci", "change_safety"],
    "verification_score": ["repo_id", "merge_rate", "pass_rate", "open_prs", "verification"],
    "repo_scores": ["repo_id", "full_name", "structure", "dependency", "change_safety", "verification", "score"],
}
for _name, _columns in SCORES.items():
    query(SIGNAL_VIEWS, f"with {SIGNALS} select {', '.join(_columns)} from fin", _name)(lambda d, columns=_columns: scoring.scored(_signals(d)).select(*columns))
    ORACLES[_name] = ORACLES[_name].replace("with ", "with recursive ", 1)


JSON_LIST = """'["' || array_to_string({}, '","') || '"]'"""
NAME = "string_split({}, '/')[-1]"
FOUND = (
    (1, "cycles_count > 0", "critical", "'Circular dependency cycle detected (' || cycles_count || ' total)'", f"""'{{"cycles_count":' || cycles_count || ',"sample_cycle":' || {JSON_LIST.format('sample')} || '}}'""",
        f"""'Cycle in module graph (' || array_to_string(list_transform(sample[1:4], lambda p: {NAME.format('p')}), ' → ') || case when len(sample) > 4 then ' …' else '' end || ') causes execution order race conditions and memory leaks.'""",
        "'Refactor shared exports into a separate module to break the cycle at ' || sample[1] || '.'", "'?focus=' || sample[1]"),
    (2, "breaking_count > 0", "critical", "breaking_count || ' upstream breaking changes pending patch validation'", f"""'{{"packages":' || {JSON_LIST.format('breaking_packages')} || ',"count":' || breaking_count || '}}'""",
        "'Active runtime or signature discrepancies in imported dependencies threaten build stability.'", "'Review and merge automated synthetic AST patches generated by the engine.'", "''"),
    (3, "max_fan_in >= 15", "warning", f"'High fan-in architectural nexus: ' || {NAME.format('hub_path')}", """'{"path":"' || hub_path || '","fan_in":' || max_fan_in || ',"fan_out":' || hub_out || '}'""",
        "hub_path || ' is imported by ' || max_fan_in || ' files. Any breaking modification propagates widely.'", "'Decouple core interfaces and protect with strict unit test coverage.'", "'?focus=' || hub_path"),
    (4, "not has_tests", "warning", "'No automated test suite detected in repository'", """'{"test_files_count":0}'""",
        "'Automated patch verification and regression prevention require test verification suites.'", "'Add test suites (e.g. pytest, vitest, jest) matching project runtime.'", "''"),
    (5, "not has_ci", "info", "'GitHub Actions CI pipeline not configured'", """'{"ci_workflows":[]}'""",
        "'Pushing changes without automated CI gates risks landing undetected breakage.'", "'Add a .github/workflows/ci.yml workflow for continuous verification.'", "''"),
    (6, "unresolved_count > 0", "info", "unresolved_count || ' unresolved static import specifiers'", """'{"sample_file":"' || gap_path || '","specifiers":' || gap_n || '}'""",
        "'Dynamic requires or missing alias path mappings limit static boundary analysis.'", "'Ensure tsconfig/jsconfig paths are synchronized and avoid dynamic imports in core files.'", "'?focus=' || gap_path"),
)


@query(SIGNAL_VIEWS, f"with {SIGNALS} " + " union all ".join(f"select repo_id, {n} as rule, '{severity}' as severity, {title} as title, {evidence} as evidence, {why} as why, {what} as what, {link} as link from fin where {hit}" for n, hit, severity, title, evidence, why, what, link in FOUND))
def findings(d: Domain) -> DataFrame:
    return scoring.findings(scoring.scored(_signals(d)))


ORACLES["findings"] = ORACLES["findings"].replace("with ", "with recursive ", 1)


@query("jobs", f"""with running as (select installation_id, count(*) as n from jobs where status = 'running' and installation_id is not null group by 1),
    due as (select j.*, row_number() over (partition by j.installation_id order by created_at, id) as place, n from jobs j left join running using (installation_id) where status = 'queued' and run_after <= {NOW})
    select id, installation_id, job_type, attempts from due where installation_id is null or coalesce(n, 0) + place <= 3 order by created_at, id limit 20""")  # fmt: skip
def fair_dequeue(d: Domain) -> DataFrame:
    return scheduling.fair_dequeue(d.jobs, F.expr(NOW.replace("timestamp", "timestamp_ntz")))


@query("jobs", f"select id, attempts, case when attempts >= max_attempts then 'failed' else 'queued' end as status from jobs where status = 'running' and locked_at < {NOW} - interval 300 seconds")
def reap_leases(d: Domain) -> DataFrame:
    return scheduling.reap_leases(d.jobs, F.expr(NOW.replace("timestamp", "timestamp_ntz")))


@query("jobs", "select id, package_id, version from jobs where status = 'failed' and (package_id, version) not in (select (package_id, version) from jobs where status in ('queued', 'running'))")
def debounce(d: Domain) -> DataFrame:
    return scheduling.debounced(d.jobs.where("status = 'failed'").select("id", "package_id", "version"), d.jobs, ["package_id", "version"]).select("id", "package_id", "version")


@query("jobs", "select min(id) as id, package_id, version from jobs group by package_id, version")
def dedup_jobs(d: Domain) -> DataFrame:
    return d.jobs.groupBy("package_id", "version").agg(F.min("id").alias("id"))


@query("incident_events", "select repo_id, arg_max(event_type, (created_at, id)) as event_type, max(created_at) as at from incident_events group by repo_id")
def current_state(d: Domain) -> DataFrame:
    return d.incident_events.groupBy("repo_id").agg(F.max_by("event_type", F.struct("created_at", "id")).alias("event_type"), F.max("created_at").alias("at"))


@query("atlas_nodes atlas_edges", "select e.* from atlas_edges e where not exists (select 1 from atlas_nodes n where n.repo_id = e.repo_id and n.path = e.source_path and node % 10 = 0) and not exists (select 1 from atlas_nodes n where n.repo_id = e.repo_id and n.path = e.target_path and node % 10 = 0)")
def graph_remove(d: Domain) -> DataFrame:
    return sinks.without_nodes(d.atlas_edges, d.atlas_nodes.where("node % 10 = 0")).select("repo_id", "source_path", "target_path")


@query("atlas_nodes", "select repo_id, node, path, ext, unresolved from atlas_nodes where node % 10 <> 0 union all select repo_id, node, path, '.new', 0 from atlas_nodes where node % 10 = 0")
def graph_upsert(d: Domain) -> DataFrame:
    new = d.atlas_nodes.where("node % 10 = 0").withColumn("ext", F.lit(".new")).withColumn("unresolved", F.lit(0))
    return sinks.upserted(d.atlas_nodes, new, ["repo_id", "path"])


@query("repos", "select id, id % 2 = 0 as is_active from repos union all select 1000000 + id, true from repos where id < 5")
def snapshot_diff(d: Domain) -> DataFrame:
    snapshot = d.repos.where("id % 2 = 0").select("id").union(d.repos.where("id < 5").select((F.col("id") + 1000000).alias("id")))
    return sinks.snapshot_diff(d.repos, snapshot)


HEADS = """heads as (select id, case when score % 6 > 0 then score % 4 end as h, case when score % 5 > 0 then score % 4 + case when score % 7 = 0 then 1 else 0 end end as b,
    case when score % 13 > 0 then score % 4 + case when score % 11 = 0 then 1 else 0 end end as n, id % 4 as t from analysis_runs)"""


def _heads(d: Domain) -> DataFrame:
    part = lambda n: F.col("score") % n
    return d.analysis_runs.select(
        "id", F.when(part(6) > 0, part(4)).alias("h"), F.when(part(5) > 0, part(4) + (part(7) == 0).cast("int")).alias("b"), F.when(part(13) > 0, part(4) + (part(11) == 0).cast("int")).alias("n"), (F.col("id") % 4).alias("t")
    )


@query("analysis_runs", f"""with {HEADS} select id, case when h <> b then case when h = t then 'skipped' else 'stale' end when n <> t and (coalesce(b, h) is null or n <> coalesce(b, h)) then 'conflict' else 'publish' end as decision from heads""")
def publish_decision(d: Domain) -> DataFrame:
    return _heads(d).select("id", scheduling.publish_decision("h", "b", "n", "t").alias("decision"))


@query("analysis_runs", f"with {HEADS} select id, case when n is null then b is not null else n <> t and (b is null or n <> b) end as is_stale from heads")
def full_build_publish(d: Domain) -> DataFrame:
    return _heads(d).select("id", scheduling.full_build_is_stale("n", "b", "t").alias("is_stale"))


@query("atlas_nodes", f"""with n as (select *, {FOLDER.format('path')} as folder from atlas_nodes), r as (select *, row_number() over (partition by repo_id, folder order by path) - 1 as rank, count(*) over (partition by repo_id, folder) as files from n)
    select repo_id, path, rank, rank // 10 as tier, round(greatest(2.6, ceil(sqrt(files)) * 1.6) + rank // 10 * 2.2, 5)::double as radius, round(2 * pi() * rank / files, 5) as angle from r""")  # fmt: skip
def node_seeds(d: Domain) -> DataFrame:
    return graph.node_seeds(d.atlas_nodes)


LISTED = """string_agg('{"id":"' || path || '","name":"' || string_split(path, '/')[-1] || '","dir":"' || case when path like '%/%' then regexp_replace(path, '/[^/]*$', '') else '' end || '","ext":"' || ext || '"}', ',' order by path)"""


@query("atlas_nodes atlas_edges", f"""with n as (select repo_id, count(*) as node_count, {LISTED} as nodes from atlas_nodes group by repo_id),
    e as (select repo_id, count(*) as edge_count, string_agg('{{"source":"' || source_path || '","target":"' || target_path || '"}}', ',' order by source_path, target_path) as edges from atlas_edges group by repo_id)
    select repo_id, node_count, coalesce(edge_count, 0) as edge_count, sha256('{{"nodes":[' || nodes || '],"edges":[' || coalesce(edges, '') || ']}}') as document_sha256 from n left join e using (repo_id)""")  # fmt: skip
def graph_document(d: Domain) -> DataFrame:
    # the document itself is read back, so that it is built
    rows = graph.graph_documents(d.atlas_nodes, d.atlas_edges)
    size = lambda path: F.json_array_length(F.get_json_object("graph_json", path)).cast("long")
    return rows.select("repo_id", size("$.nodes").alias("node_count"), size("$.edges").alias("edge_count"), F.sha2("graph_json", 256).alias("document_sha256"))


@query(sql="select l_orderkey, l_linenumber, l_partkey, l_quantity, round(case when abs(dy) > 1.2 then middle - least(1.2, greatest(0.25, flat * 0.1)) else middle + least(1.8, greatest(0.35, sqrt(flat * flat + dy * dy) * 0.15)) end, 6) as y from (select *, l_tax * 20 as dy, sqrt(l_discount * l_discount * 10000 + l_quantity * l_quantity) as flat, l_tax * 10 as middle from lineitem)")
def wire_midpoints(d: Domain) -> DataFrame:
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("z1"), (F.col("l_discount") * 100).alias("x2"), (F.col("l_tax") * 20).alias("y2"), F.col("l_quantity").alias("z2"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(graph.wire_midpoint("x1", "y1", "z1", "x2", "y2", "z2"), 6).alias("y"))


@query("incident_events repos patches code_usages", """select e.id, coalesce(p.installation_id, q.installation_id) as installation_id from incident_events e left join repos p on p.id = e.repo_id and e.id % 2 = 0
    left join code_usages u on u.id = e.code_usage_id left join repos q on q.id = u.repo_id""")  # fmt: skip
def job_owners(d: Domain) -> DataFrame:
    jobs = d.incident_events.select("id", F.lit(None).cast("int").alias("installation_id"), F.when(F.col("id") % 2 == 0, F.col("repo_id")).alias("repo_id"), "code_usage_id", F.lit(None).cast("long").alias("patch_id"))
    return lookup.job_owners(jobs, d.repos, d.code_usages, d.patches)


@query("jobs", "select installation_id, count(*) as running from jobs where status = 'running' and installation_id is not null group by all")
def running_jobs(d: Domain) -> DataFrame:
    return lookup.running_jobs(d.jobs)


@query("atlas_nodes", """with asked as (select repo_id, path as focus from atlas_nodes where node % 3 = 0 union select repo_id, 'n' || node || '.ts' from atlas_nodes where node % 5 = 0),
    exact as (select a.*, n.path from asked a left join atlas_nodes n on n.repo_id = a.repo_id and n.path = a.focus),
    suffix as (select a.repo_id, a.focus, case when count(*) = 1 then min(n.path) end as path from asked a join atlas_nodes n on n.repo_id = a.repo_id and ends_with(n.path, '/' || a.focus) group by all)
    select e.repo_id, e.focus, coalesce(e.path, s.path) as path from exact e left join suffix s on s.repo_id = e.repo_id and s.focus = e.focus""")  # fmt: skip
def focus_paths(d: Domain) -> DataFrame:
    nodes = d.atlas_nodes
    asked = nodes.where("node % 3 = 0").select("repo_id", F.col("path").alias("focus")).union(nodes.where("node % 5 = 0").select("repo_id", F.concat(F.lit("n"), F.col("node").cast("string"), F.lit(".ts")))).distinct()
    return lookup.focus_paths(asked, nodes)


@query("jobs", "select package_id, count(distinct version) as checks, bool_and(status = 'done') as completed, bool_and(status = 'done' and attempts < 2) as verified from (select *, row_number() over (partition by package_id, version order by created_at desc, id desc) as rn from jobs) where rn = 1 group by package_id")
def check_polls(d: Domain) -> DataFrame:
    polls = d.jobs.select(F.col("package_id").alias("commit"), F.col("version").alias("name"), F.struct("created_at", "id").alias("at"), F.when(F.col("status") == "done", "completed").otherwise("queued").alias("status"), F.when((F.col("status") == "done") & (F.col("attempts") < 2), "success").otherwise("failure").alias("conclusion"))
    return lookup.check_polls(polls).withColumnRenamed("commit", "package_id")


@query(sql="select event_type, count(*) as events, count(*) filter (cast(json_extract_string(props, '$.k') as varchar) is not null) as keyed from events group by event_type")
def json_filter(d: Domain) -> DataFrame:
    return d.table("events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("keyed"))


@query(sql="select date_trunc('day', ts) as day, event_type, count(*) as events from events group by all")
def activity_windows(d: Domain) -> DataFrame:
    rows = stateful.activity_windows(d.table("events").withColumn("created_at", F.col("ts").cast("timestamp")), "1 day")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "events")
