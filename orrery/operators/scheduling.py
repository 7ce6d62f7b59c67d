"""Work queues as tables: fair dequeue, leases, debouncing, push plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RUNNING_CAP, LEASE_SECONDS, RETRY_SECONDS = 3, 300, 30
FULL_SHARE, FULL_DAYS = 0.40, 7
POLL_MINUTES = 15
# The stages in their order.
STAGES = ("poll_registry", "extract_changes", "scan_repo", "generate_patch", "validate_patch", "open_pr")


def fair_dequeue(jobs: DataFrame, now: Column, n: int = 20, cap: int = RUNNING_CAP) -> DataFrame:
    """The oldest queued jobs that are due, at most ``cap`` running ones per installation; jobs without one always qualify."""
    columns = ("id", "installation_id", "job_type", "attempts", "created_at")
    running = jobs.where("status = 'running' and installation_id is not null").groupBy("installation_id").agg(F.count("*").alias("running"))
    due = jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now)).select(*columns)
    place = F.row_number().over(Window.partitionBy("installation_id").orderBy("created_at", "id"))
    first = due.where("installation_id is not null").withColumn("place", place).where(F.col("place") <= cap)
    first = first.join(running, "installation_id", "left").where(F.coalesce("running", F.lit(0)) + F.col("place") <= cap).select(*columns)
    # Jobs without an installation need no rank, and no task holds them all.
    free = due.where("installation_id is null").orderBy("created_at", "id").limit(n)
    return first.union(free).orderBy("created_at", "id").limit(n).select(*columns[:4])


def reap_leases(jobs: DataFrame, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """Running jobs whose lease has run out: failed when their attempts are used up, else queued again."""
    expired = (F.col("status") == "running") & (F.col("locked_at") < now - F.expr(f"interval {lease} seconds"))
    return jobs.where(expired).select("id", "attempts", F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("queued").alias("status"))


def retry_delay(attempts: str) -> Column:
    """Seconds before the next attempt: linear."""
    return F.col(attempts) * RETRY_SECONDS


def client_backoff_ms(attempt: str) -> Column:
    """Milliseconds before a client reconnects: doubling, 8 seconds at most."""
    return F.least(F.lit(8000), F.lit(1000) * F.pow(F.lit(2), F.col(attempt) - 1)).cast("long")


def debounced(requests: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Requests for which no job with the same keys is queued or running."""
    return requests.join(jobs.where(F.col("status").isin("queued", "running")).select(*keys), keys, "left_anti")


def push_plan(pushes: DataFrame, state: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a push asks for: ignored, skipped, full or incremental.

    ``pushes``: repo_id, ref, default_branch, before, after, truncated, commits
    (array of added, modified, removed paths).  ``state``: repo_id, head_sha,
    last_full_scan_at, node_count.  All limits are strict.
    """
    paths = lambda f: F.array_distinct(F.flatten(F.transform("commits", lambda c: F.coalesce(c[f], F.array().cast("array<string>")))))
    rows = pushes.withColumns({f: F.sort_array(paths(f)) for f in ("added", "modified", "removed")}).join(state, "repo_id", "left")
    changed = F.size(F.array_distinct(F.concat("added", "modified", "removed")))
    full = F.col("node_count").isNull() | (F.col("node_count") == 0) | (F.col("last_full_scan_at") < now - F.expr(f"interval {FULL_DAYS} days")) | (changed / F.col("node_count") > FULL_SHARE) | F.col("truncated") | (F.size("commits") >= 20)
    mode = (
        F.when(F.col("ref") != F.concat(F.lit("refs/heads/"), "default_branch"), "ignored")
        .when(F.regexp_replace("after", "0", "") == "", "ignored")
        .when(F.col("head_sha") == F.col("after"), "skipped")
        .when(full, "full")
        .otherwise("incremental")
    )
    return rows.select(*keep, "repo_id", "after", "added", "modified", "removed", changed.alias("changed"), mode.alias("mode"))


def publish_decision(head: str, base: str, now_head: str, target: str) -> Column:
    """Optimistic checks of an increment: skipped, stale, conflict or publish.

    ``head`` is the tracked commit as the job begins, ``now_head`` as it ends;
    ``base`` is the commit that the push builds on, ``target`` the job's own.  A
    base that the head has left makes the job stale, or superfluous if the head
    is its target already.  At the end the head must be the target, or still the
    one expected: the base, or the head at the beginning.
    """
    h, b, n, t = (F.nullif(F.col(c).cast("string"), F.lit("")) for c in (head, base, now_head, target))
    left = h.isNotNull() & b.isNotNull() & (h != b)
    expected = F.coalesce(b, h)
    moved = n.isNotNull() & (n != t) & (expected.isNull() | (n != expected))
    return F.when(left & (h == t), "skipped").when(left, "stale").when(moved, "conflict").otherwise("publish")


def full_build_is_stale(now_head: str, expected: str, target: str) -> Column:
    """Whether a whole graph must not replace the tracked one: the head is neither the build's commit nor the expected one, or has gone."""
    n, e, t = (F.nullif(F.col(c).cast("string"), F.lit("")) for c in (now_head, expected, target))
    return F.when(n.isNull(), e.isNotNull()).otherwise((n != t) & (e.isNull() | (n != e)))


def baseline(versions: DataFrame) -> DataFrame:
    """Versions to extract changes from: the first one seen of a package is only recorded."""
    return versions.where(F.coalesce("old_version", F.lit("none")) != "none")


def next_stages(jobs: DataFrame) -> DataFrame:
    """What each finished job enqueues: (id, next_stage), null after the last stage and for jobs outside of them."""
    following = F.create_map(*(F.lit(x) for pair in zip(STAGES, STAGES[1:], strict=False) for x in pair))
    return jobs.where(F.col("status") == "done").select("id", F.try_element_at(following, F.col("job_type")).alias("next_stage"))


def due_polls(packages: DataFrame, jobs: DataFrame, now: Column, minutes: int = POLL_MINUTES) -> DataFrame:
    """Packages without a registry poll in the last ``minutes``."""
    recent = jobs.where((F.col("job_type") == "poll_registry") & (F.col("created_at") > now - F.expr(f"interval {minutes} minutes"))).select(F.col("package_id").alias("id"))
    return packages.join(recent, "id", "left_anti")


def due_page(jobs: DataFrame, now: Column, offset: int = 0, n: int = 20) -> DataFrame:
    """One page of the queued jobs that are due, the oldest first."""
    return jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now)).orderBy("created_at", "id").offset(offset).limit(n)
