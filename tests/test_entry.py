"""The driver contract: names, schemas, and that queries agree with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from orrery.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["tenant_scope", "stats_summary", "activity_feed", "incident_snapshot", "verdict_rollup", "repo_scores", "findings", "scc_count", "fair_dequeue", "folder_closure", "patches_confidence_asc", "check_run_conclusion", "publish_decision", "registry_latest", "patch_gates", "importers_of_added", "changelog_changes", "call_sites", "resolve_imports", "best_of_n", "graph_push", "stage_machine", "incident_reducer", "rate_limit", "pr_transitions", "language_calls", "analysis_reports", "grounded_advice", "run_records", "push_payloads", "webhook_signatures", "graph_document", "blast_radius"])
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.execute(f"create view {t.split('.')[0]} as select * from '{FOLDER}/{t}'")
    df = plans.QUERIES[name](spark, FOLDER)
    found = c.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in found.fetchall()), key=str)
    assert got == want
