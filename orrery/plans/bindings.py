"""Domain views over the supplied tables, as one SQL text for both engines.

Repositories are suppliers, code usages are orders, patches are order lines
grouped by line number, and so on; sizes follow the input (``k`` holds the
number of repositories and of packages).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "k": "select (select count(*) from supplier) as ns, (select count(*) from part) as np, (select count(*) from orders) as no",
    "users": "select r_regionkey as id, lower(r_name) as login from region",
    "installations": """select n_nationkey as id, n_name as account_login, n_regionkey as installed_by,
        case when n_nationkey % 2 = 0 then 'User' else 'Organization' end as account_type from nation""",
    "repos": "select s_suppkey as id, s_nationkey as installation_id, s_name as full_name, s_acctbal > 0 as is_active, s_suppkey % 3 = 0 as requires_tests, s_suppkey % 4 = 0 as requires_typecheck from supplier",
    "packages": "select p_partkey as id, p_name as name, case when p_partkey % 2 = 0 then 'npm' else 'pypi' end as ecosystem from part",
    "repo_packages": "select distinct o_custkey % ns as repo_id, (o_orderkey * 7 + 3) % np as package_id from orders cross join k",
    "detected_changes": """select p_partkey as id, p_partkey as package_id,
        case p_size % 6 when 0 then 'removed' when 1 then 'renamed' when 2 then 'signature_change' when 3 then 'deprecated' when 4 then 'behavior_change' else 'unknown' end as change_type,
        cast(p_partkey % 100 as double) / 100 as confidence, p_brand as symbol, p_name as description,
        cast(p_partkey * 7919 % 86400 as bigint) as created_at from part""",
    "code_usages": """select o_orderkey as id, o_custkey % ns as repo_id, o_orderkey % np as detected_change_id,
        concat('src/m', cast(o_custkey % 7 as string), '/f', cast(o_custkey as string), '.ts') as file_path,
        case substring(o_orderpriority, 1, 1) when '1' then 'pending' when '2' then 'failed' when '3' then 'skipped' else 'patched' end as status,
        o_orderdate as created_at from orders cross join k""",
    "patches": """select l_orderkey * 10 + l_linenumber as id, l_orderkey as code_usage_id, max(l_linestatus) = 'O' as verified,
        max(l_shipdate) as created_at, cast(sum(l_quantity) as bigint) as diff_lines from lineitem group by l_orderkey, l_linenumber""",
    "validation_runs": """select l_orderkey * 10 + l_linenumber as patch_id,
        case l_returnflag when 'A' then true when 'R' then false end as tests_pass,
        case when l_tax < 0.03 then true when l_tax < 0.06 then false end as typechecks,
        case when l_suppkey % 17 > 0 then l_partkey % 13 > 0 end as applies_cleanly, l_partkey % 19 > 0 as parses, case when l_quantity < 49 then l_suppkey % 23 > 0 end as scope_ok,
        case when l_discount < 0.05 then 'full' else 'structural_only' end as verification_mode,
        l_shipdate as created_at, l_partkey * 100000 + l_suppkey as tie, l_extendedprice as tie2, l_discount as tie3 from lineitem""",
    "pull_requests": """select o_orderkey as id, o_custkey % ns as repo_id,
        case o_orderstatus when 'O' then 'open' when 'F' then 'merged' else 'closed' end as status, o_orderkey % 35 = 0 as merged,
        o_orderdate as opened_at from orders cross join k""",
    "pr_patches": "select distinct l_orderkey as pr_id, l_orderkey * 10 + l_linenumber as patch_id from lineitem",
    "incident_events": """select event_id as id, user_id % ns as repo_id, case when event_id % 3 = 0 then event_id % np end as detected_change_id,
        case when event_id % 3 = 1 then event_id % no end as code_usage_id,
        case event_type when 'view' then 'usage_found' when 'click' then 'patch_generated' when 'purchase' then 'pr_opened' when 'error' then 'validation_failed' else 'validation_passed' end as event_type,
        ts as created_at from events cross join k""",
    "jobs": """select event_id as id, case when event_id % 11 = 0 then null else user_id % ns % 25 end as installation_id,
        case event_id % 5 when 0 then 'running' when 1 then 'done' when 2 then 'failed' else 'queued' end as status,
        cast(event_id % 4 as int) as attempts, 3 as max_attempts, ts as created_at, ts as run_after,
        case when event_id % 5 = 0 then ts end as locked_at, event_id % np as package_id, concat('v', cast(event_id % 9 as string)) as version,
        case event_id % 3 when 0 then 'poll_registry' when 1 then 'scan_repo' else 'open_pr' end as job_type from events cross join k""",
    "atlas_nodes": """select p_partkey % ns as repo_id, p_partkey as node,
        concat(case p_size % 4 when 0 then 'src/' when 1 then 'src/core/' when 2 then 'test/' else '' end, 'n', cast(p_partkey as string),
            case p_size % 7 when 0 then '.md' when 1 then '.py' when 2 then '.test.ts' else '.ts' end) as path,
        case p_size % 7 when 0 then '.md' when 1 then '.py' else '.ts' end as ext,
        case when p_size % 9 = 0 then p_size % 4 else 0 end as unresolved from part cross join k""",
    "atlas_links": """select distinct l_partkey as src, (l_partkey + ns * cast(l_quantity as int)) % np as tgt
        from lineitem cross join k""",
    "atlas_edges": """select a.repo_id, a.path as source_path, b.path as target_path from atlas_links
        join atlas_nodes a on a.node = src join atlas_nodes b on b.node = tgt""",
    "analysis_runs": """select o_orderkey as id, o_custkey % ns as repo_id, cast(floor(o_totalprice) as bigint) % 101 as score, o_orderdate as created_at
        from orders cross join k""",
}
# The sizes enter as scalar subqueries, not as joins.
VIEWS = {name: re.sub(r"\b(ns|np|no)\b", r"(select \1 from k)", text.replace(" cross join k", "")) if name != "k" else text for name, text in VIEWS.items()}
NEEDS = {
    "repo_packages": ["k"], "code_usages": ["k"], "pull_requests": ["k"], "incident_events": ["k"], "jobs": ["k"], "atlas_nodes": ["k"], "atlas_links": ["k"],
    "atlas_edges": ["k", "atlas_nodes", "atlas_links"], "analysis_runs": ["k"],
}


def with_clause(*names: str) -> str:
    """``with`` clause of the named views and of what they need."""
    order: list[str] = []
    for name in names:
        order += [x for x in [*NEEDS.get(name, []), name] if x not in order]
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in order) + " "


# Rows of the links' table for each partition of a shuffle, and MB that adaptive execution may join to one.
ROWS_IN_PARTITION, JOINED_MB = 500_000, 16


class Domain:
    """The domain views of one folder of tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _deal_links(self) -> None:
        """Shuffles get partitions by the rows of the links' table, so that a task's share does not grow with it; the settings stay for later queries of the session."""
        conf = self.spark.conf
        parts = -(-self.table("lineitem").count() // ROWS_IN_PARTITION)
        if parts > int(conf.get("spark.sql.shuffle.partitions")):
            conf.set("spark.sql.shuffle.partitions", parts)
            conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{JOINED_MB}m")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if "atlas_links" in (name, *NEEDS.get(name, [])):
            self._deal_links()
        for raw in RAW:
            if any(raw in VIEWS[v] for v in [name, *NEEDS.get(name, [])]):
                self.table(raw).createOrReplaceTempView(raw)
        return self.spark.sql(with_clause(name) + f"select * from {name}")
