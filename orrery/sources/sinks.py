"""Changes to tables as functions from old rows to new ones, and the checks before a write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.text import uuid_or_null

# The enumerations of the stored tables.
ENUMS = {
    ("installations", "account_type"): ("User", "Organization"),
    ("packages", "ecosystem"): ("npm", "pypi"),
    ("detected_changes", "change_type"): ("removed", "renamed", "signature_change", "behavior_change", "deprecated"),
    ("code_usages", "status"): ("pending", "patched", "skipped", "failed"),
    ("pull_requests", "status"): ("open", "merged", "closed"),
    ("detected_changes", "source"): ("npm_registry", "internal_runtime"),
    ("jobs", "job_type"): ("poll_registry", "extract_changes", "scan_repo", "generate_patch", "validate_patch", "open_pr", "build_atlas_graph"),
    ("jobs", "status"): ("queued", "running", "done", "failed"),
    ("incident_events", "event_type"): (
        "change_detected", "scan_started", "usage_found", "patch_generating", "patch_generated", "patch_failed", "validating", "validation_passed", "validation_failed",
        "pr_opened", "pr_merged", "pr_closed", "usage_skipped", "usage_failed", "job_queued", "job_running", "job_done", "job_failed",
    ),
}


EVENT_IDS = ("repo_id", "detected_change_id", "code_usage_id", "job_id")


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that repeat a key the greatest, column by column."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*(F.col(f"_row.{c}") if c in rest else F.col(c) for c in rows.columns)) if rest else rows.distinct()


def recorded_events(events: DataFrame) -> DataFrame:
    """Events to append: ids that are no UUIDs become null, a missing payload an empty one."""
    ids = {c: uuid_or_null(c) for c in EVENT_IDS if c in events.columns}
    return events.withColumns(ids | {"payload": F.coalesce("payload", F.lit("{}"))})


def replaced_graphs(edges: DataFrame, built: DataFrame) -> DataFrame:
    """Edges after whole graphs (repo_id, source_path, target_path) have replaced those of their repositories."""
    return edges.join(built.select("repo_id").distinct(), "repo_id", "left_anti").unionByName(built)


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, the greatest of each key."""
    return one_per_key(new, keys).join(current.select(*keys).distinct(), keys, "left_anti")


def upserted(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows, the greatest of each key, and the current ones whose key is not among them."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(one_per_key(new, keys), allowMissingColumns=True)


def snapshot_diff(current: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """All known keys with ``is_active``: whether the new snapshot has them."""
    here = snapshot.select(key, F.lit(True).alias("_here"))
    return current.select(key).join(here, key, "full_outer").select(key, F.coalesce("_here", F.lit(False)).alias("is_active"))


def synced(current: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """``current`` after a snapshot: its rows overwrite or join, rows that it lacks stay but are not active."""
    columns = [c for c in snapshot.columns if c != key]
    fresh = snapshot.select(key, F.lit(True).alias("_here"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    rows = current.drop("is_active").join(fresh, key, "full_outer")
    here = F.coalesce("_here", F.lit(False))
    return rows.select(key, *(F.when(here, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns), here.alias("is_active"))


def partial_update(current: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Only the patch's non-null cells overwrite."""
    columns = [c for c in patch.columns if c != key]
    changes = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return current.join(changes, key, "left").select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the given nodes (repo_id, path)."""
    kept = edges.join(nodes.select("repo_id", F.col("path").alias("source_path")), ["repo_id", "source_path"], "left_anti")
    return kept.join(nodes.select("repo_id", F.col("path").alias("target_path")), ["repo_id", "target_path"], "left_anti")


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children whose parent survives."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")


def cascaded(tables: dict[str, DataFrame], links: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """All tables after a deletion: ``links`` (child, foreign key, parent) in order, parents first; rows without a foreign key stay."""
    left = dict(tables)
    for child, foreign, parent in links:
        rows = left[child]
        left[child] = cascade(rows.where(F.col(foreign).isNotNull()), left[parent], foreign).select(*rows.columns).unionByName(rows.where(F.col(foreign).isNull()))
    return left


def violations(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Values outside their enumerations and keys that occur more than once: (rule, value, rows)."""
    out = None
    for (owner, column), allowed in ENUMS.items():
        if owner == table:
            bad = df.where(~F.col(column).isin(*allowed)).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows")).select(F.lit(f"enum {column}").alias("rule"), "value", "rows")
            out = bad if out is None else out.union(bad)
    twice = df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(F.lit("unique " + ", ".join(keys)).alias("rule"), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)).alias("value"), "rows")
    return twice if out is None else out.union(twice)


def pr_transitions(prs: DataFrame, events: DataFrame) -> DataFrame:
    """Pull requests (id, status, closed_at, merged, merged_at) after their webhook events (pr_id, action, merged, merged_at, closed_at, at; ``at`` is when it came).

    The last ``closed`` or ``reopened`` decides.  Times that an event lacks are
    those of its coming; a merge time outlives a close without merge.
    """
    last = events.where(F.col("action").isin("closed", "reopened")).groupBy(F.col("pr_id").alias("id")).agg(F.max_by(F.struct("action", "merged", "merged_at", "closed_at", "at"), F.struct("at", "action")).alias("e"))
    rows = prs.join(last, "id", "left")
    closed, reopened = F.coalesce(F.col("e.action") == "closed", F.lit(False)), F.coalesce(F.col("e.action") == "reopened", F.lit(False))
    merged = closed & F.coalesce("e.merged", F.lit(False))
    return rows.select(
        "id",
        F.when(merged, "merged").when(closed, "closed").when(reopened, "open").otherwise(F.col("status")).alias("status"),
        F.when(closed, F.coalesce("e.closed_at", "e.at")).when(~reopened, F.col("closed_at")).alias("closed_at"),
        F.when(closed, merged).when(reopened, False).otherwise(F.col("merged")).alias("merged"),
        F.when(merged, F.coalesce("e.merged_at", "e.at")).when(~reopened, F.col("merged_at")).alias("merged_at"),
    )


def append_once(df: DataFrame, path: str, batch: int) -> None:
    """Appends a batch to the table at ``path``; the same batch again replaces itself, so a replay leaves the table as it was."""
    df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def appending(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every micro-batch is in the table once, however often it is tried."""
    return lambda df, batch: append_once(df, path, batch)
