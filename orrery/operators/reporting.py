"""Relational reports: counts, feeds, lists, incident snapshots.

Where the order of rows decides (latest, first, top) it is total: time first,
then id.  Null order is stated, as PostgreSQL and Spark differ in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LOW_CONFIDENCE = 0.75


def semantic_risk(change_type: str = "change_type", confidence: str = "confidence") -> Column:
    """Behaviour changes always; signature changes and deprecations below 0.75.  Never null."""
    kind, sure = F.col(change_type), F.col(confidence)
    return F.coalesce((kind == "behavior_change") | (kind.isin("signature_change", "deprecated") & (sure < LOW_CONFIDENCE)), F.lit(False))


def mechanical(change_type: str = "change_type", confidence: str = "confidence") -> Column:
    """Removals, renames, and sure signature changes or deprecations.  Unknown types are neither this nor risky."""
    kind, sure = F.col(change_type), F.col(confidence)
    return F.coalesce(kind.isin("removed", "renamed") | (kind.isin("signature_change", "deprecated") & (sure >= LOW_CONFIDENCE)), F.lit(False))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that is greatest in the given columns, found by an aggregate that starts before the shuffle."""
    row = F.struct(*(c for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def stats_summary(repos: DataFrame, prs: DataFrame, usages: DataFrame, patches: DataFrame) -> DataFrame:
    """One row of counts and the merge rate (0.0 without pull requests, three decimals)."""
    active = repos.agg(F.count_if("is_active").alias("active_repos"))
    pulls = prs.agg(F.count("*").alias("prs_opened"), F.count_if(F.col("merged") | (F.col("status") == "merged")).alias("prs_merged"))
    made = patches.join(usages.select(F.col("id").alias("code_usage_id")), "code_usage_id", "left_semi").agg(F.count("*").alias("patches"), F.count_if("verified").alias("verified_patches"))
    rate = F.coalesce(F.bround(F.try_divide(F.col("prs_merged").cast("double"), F.col("prs_opened")), 3), F.lit(0.0))
    return active.join(pulls).join(made).withColumn("merge_rate", rate)  # three one-row inputs


def funnel_metrics(repos: DataFrame, changes: DataFrame, usages: DataFrame, patches: DataFrame, prs: DataFrame) -> DataFrame:
    return (
        repos.agg(F.count("*").alias("repos_watched"))
        .join(changes.agg(F.count("*").alias("changes_detected")))
        .join(usages.agg(F.count("*").alias("usages_found")))
        .join(patches.agg(F.count("*").alias("patches_generated"), F.count_if("verified").alias("patches_verified")))
        .join(prs.agg(F.count("*").alias("prs_opened"), F.count_if(F.col("merged") | (F.col("status") == "merged")).alias("prs_merged")))
    )


def recent_changes(changes: DataFrame, usages: DataFrame, keep: Column | None = None, n: int = 5) -> DataFrame:
    """Newest changes, one row per usage: a change used twice comes twice."""
    used = changes.join(usages.select(F.col("detected_change_id").alias("id"), F.col("id").alias("usage_id")), "id")
    used = used.where(keep) if keep is not None else used
    return used.orderBy(F.desc("created_at"), F.desc("id"), F.desc("usage_id")).limit(n).select("id", "usage_id", "change_type", "confidence", "created_at")


def activity_feed(prs: DataFrame, patches: DataFrame, usages: DataFrame, runs: DataFrame, changes: DataFrame, each: int = 20, n: int = 50) -> DataFrame:
    """Newest of three kinds, merged by time; a patch carries whether its last run passed.  Only the runs of the patches shown are ranked."""
    newest = [F.desc("happened_at"), F.desc("id")]
    pull = prs.select(F.lit("pull_request").alias("kind"), "id", F.col("opened_at").alias("happened_at"), "repo_id", F.col("merged").alias("flag")).orderBy(*newest).limit(each)
    patch = patches.join(usages.select(F.col("id").alias("code_usage_id"), "repo_id"), "code_usage_id").select(F.lit("patch").alias("kind"), "id", F.col("created_at").alias("happened_at"), "repo_id").orderBy(*newest).limit(each)
    last = latest_runs(runs.join(patch.select(F.col("id").alias("patch_id")), "patch_id", "left_semi")).select(F.col("patch_id").alias("id"), "tests_pass")
    patch = patch.join(last, "id", "left").select("kind", "id", "happened_at", "repo_id", F.col("tests_pass").alias("flag"))
    change = usages.join(changes.select(F.col("id").alias("detected_change_id")), "detected_change_id").select(F.lit("change").alias("kind"), "id", F.col("created_at").alias("happened_at"), "repo_id").orderBy(*newest).limit(each)
    return pull.union(patch).unionByName(change, allowMissingColumns=True).orderBy(F.desc_nulls_last("happened_at"), "kind", F.desc("id")).limit(n)


def patch_list(patches: DataFrame, usages: DataFrame, changes: DataFrame, order: str = "default", n: int = 20) -> DataFrame:
    """A page of patches: the database's order picks ``n`` rows, a second order arranges them.

    In the first order nulls come first when descending, as PostgreSQL has it.
    In the second an unknown risk counts as none, an unknown confidence as 1
    when ascending and 0 when descending.
    """
    rows = patches.select("id", "code_usage_id", "verified", "created_at").join(usages.select(F.col("id").alias("code_usage_id"), "detected_change_id", "repo_id"), "code_usage_id")
    risky = changes.select(F.col("id").alias("detected_change_id"), semantic_risk().alias("is_semantic_risk"), "confidence")
    rows = rows.join(risky, "detected_change_id", "left")
    newest = [F.desc("created_at"), F.desc("id")]
    first = {
        "default": newest,
        "risk_first": [F.desc_nulls_first("is_semantic_risk"), *newest],
        "confidence_asc": [F.asc_nulls_last("confidence"), *newest],
        "confidence_desc": [F.desc_nulls_first("confidence"), *newest],
    }[order]
    second = {
        "default": newest,
        "risk_first": [F.desc(F.coalesce("is_semantic_risk", F.lit(False))), *newest],
        "confidence_asc": [F.asc(F.coalesce("confidence", F.lit(1.0))), *newest],
        "confidence_desc": [F.desc(F.coalesce("confidence", F.lit(0.0))), *newest],
    }[order]
    page = rows.orderBy(*first).limit(n)
    return page.withColumn("position", F.row_number().over(Window.orderBy(*second))).select("position", "id", "repo_id", "verified", "is_semantic_risk", "confidence")


def review_digest(patches: DataFrame, usages: DataFrame, changes: DataFrame, page: int = 2, size: int = 20) -> DataFrame:
    """A page of verified patches of risky changes, newest first, with the total number."""
    size, page = max(1, min(size, 100)), max(1, page)
    rows = patches.where("verified").join(usages.select(F.col("id").alias("code_usage_id"), "detected_change_id", "repo_id"), "code_usage_id")
    rows = rows.join(changes.where(semantic_risk()).select(F.col("id").alias("detected_change_id"), "confidence"), "detected_change_id")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size).select("id", "repo_id", "confidence").join(total)


def repo_pr_counts(repos: DataFrame, prs: DataFrame) -> DataFrame:
    counts = prs.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("n"))
    return repos.select("id", "full_name").join(counts, "id", "left").select("id", "full_name", F.coalesce("n", F.lit(0)).alias("pr_count"))


def active_incidents(usages: DataFrame, changes: DataFrame, packages: DataFrame) -> DataFrame:
    """Changes that some usage has not been patched for; failed and skipped usages stay active."""
    named = changes.join(packages.select(F.col("id").alias("package_id"), F.col("name").alias("package_name")), "package_id", "left")
    open_ = usages.where(F.col("status") != "patched").select("repo_id", F.col("detected_change_id").alias("id"))
    return named.join(open_, "id").select("repo_id", "id", F.coalesce("package_name", F.lit("unknown")).alias("package_name"), "change_type").distinct()


def best_patches(patches: DataFrame) -> DataFrame:
    """Of each usage the first verified patch, else the first."""
    row = F.struct(*(c for c in patches.columns if c != "code_usage_id"))
    return patches.groupBy("code_usage_id").agg(F.min_by(row, F.struct(~F.col("verified"), "created_at", "id")).alias("_row")).select("code_usage_id", "_row.*")


def latest_runs(runs: DataFrame) -> DataFrame:
    return latest(runs, ["patch_id"], F.col("created_at"), F.col("tie"), F.col("tie2"), F.col("tie3"))


def incident_snapshot(usages: DataFrame, patches: DataFrame, runs: DataFrame, pr_patches: DataFrame, prs: DataFrame) -> DataFrame:
    """Each usage with its best patch, that patch's last run and its latest pull request."""
    best = best_patches(patches).select(F.col("id").alias("patch_id"), F.col("code_usage_id").alias("id"), "verified")
    last = latest_runs(runs).select("patch_id", "tests_pass", "typechecks")
    pulls = pr_patches.join(prs.select(F.col("id").alias("pr_id"), "opened_at", F.col("status").alias("pr_status")), "pr_id")
    pulls = pulls.groupBy("patch_id").agg(F.max_by(F.struct("pr_id", "pr_status"), F.struct("opened_at", "pr_id")).alias("pr"))
    rows = usages.select("id", "repo_id", "detected_change_id", "status").join(best, "id", "left").join(last, "patch_id", "left").join(pulls, "patch_id", "left")
    return rows.select("id", "repo_id", "detected_change_id", "status", "patch_id", "verified", "tests_pass", "typechecks", F.col("pr.pr_id").alias("pr_id"), F.col("pr.pr_status").alias("pr_status"))


def incident_history(events: DataFrame, usages: DataFrame, change_id: int, since: str | None = None, n: int = 500) -> DataFrame:
    """Events of a change, directly or through a usage, oldest first; a malformed ``since`` is ignored."""
    through = usages.where(F.col("detected_change_id") == change_id).select(F.col("id").alias("code_usage_id"))
    direct = F.coalesce(F.col("detected_change_id") == change_id, F.lit(False))
    rows = events.where(direct).unionByName(events.where(~direct).join(through, "code_usage_id", "left_semi"))
    after = F.try_to_timestamp(F.lit(since))
    rows = rows.where(after.isNull() | (F.col("created_at") > after)) if since is not None else rows
    return rows.orderBy("created_at", "id").limit(min(n, 2000)).select("id", "repo_id", "event_type", "created_at")


def breakages_by_file(usages: DataFrame) -> DataFrame:
    return usages.where(F.col("status") != "patched").groupBy("repo_id", "file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_set("detected_change_id")), lambda x: x.cast("string")), ",").alias("change_ids"))


def run_deltas(runs: DataFrame) -> DataFrame:
    """Every run with its change against the one before; 0 for the first."""
    before = F.lag("score").over(Window.partitionBy("repo_id").orderBy("created_at", "id"))
    return runs.select("id", "repo_id", "score", F.coalesce(F.col("score") - before, F.lit(0)).alias("delta"))


def previous_version(versions: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """Each row's predecessor by published time (unknown times last), ``none`` for the first one known."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("published_at"), F.asc(id_column))
    return versions.withColumn("old_version", F.coalesce(F.lag("version").over(order), F.lit("none")))


def tri_all(flag: str, known: str) -> Column:
    """ALL in three values over a group: a missing run gives null, else a false gives false, else a null gives null."""
    f = F.col(flag)
    return F.when(F.count_if(F.col(known).isNull()) > 0, F.lit(None)).when(F.count_if(f == F.lit(False)) > 0, F.lit(False)).when(F.count_if(f.isNull()) > 0, F.lit(None)).otherwise(F.lit(True))


def verdict_rollup(pr_patches: DataFrame, patches: DataFrame, runs: DataFrame, usages: DataFrame, changes: DataFrame) -> DataFrame:
    """Per pull request: risk, least confidence, change types, and whether all last runs passed, in three values."""
    last = latest_runs(runs).select("patch_id", "tests_pass", "typechecks", F.lit(True).alias("has_run"))
    rows = pr_patches.join(patches.select(F.col("id").alias("patch_id"), "code_usage_id"), "patch_id").join(usages.select(F.col("id").alias("code_usage_id"), F.col("detected_change_id")), "code_usage_id")
    rows = rows.join(changes.select(F.col("id").alias("detected_change_id"), "change_type", "confidence", semantic_risk().alias("risk")), "detected_change_id", "left").join(last, "patch_id", "left")
    rolled = rows.groupBy("pr_id").agg(
        F.bool_or(F.coalesce("risk", F.lit(True))).alias("is_semantic_risk"), F.min("confidence").alias("confidence"),
        F.array_join(F.sort_array(F.collect_set("change_type")), ", ").alias("change_types"), tri_all("tests_pass", "has_run").alias("tests_passed"), tri_all("typechecks", "has_run").alias("types_passed"),
    )
    return rolled.withColumn("needs_review", needs_review("tests_passed", "types_passed", "is_semantic_risk", F.lit(False)))


def needs_review(tests: str, types: str, risk: str, covered: Column) -> Column:
    """A person must look unless tests and types passed, the change is no risk and its symbol is covered."""
    return ~F.coalesce(F.col(tests), F.lit(False)) | ~F.coalesce(F.col(types), F.lit(False)) | F.col(risk) | ~covered


def check_conclusion(pr_patches: DataFrame, runs: DataFrame) -> DataFrame:
    """Per pull request: failure if a last run is structurally unsound or has failed tests or types, neutral if one is missing, else success."""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    sound = true("applies_cleanly") & true("parses") & true("scope_ok") & F.coalesce("tests_pass", F.lit(True)) & F.coalesce("typechecks", F.lit(True))
    last = latest_runs(runs).select("patch_id", sound.alias("sound"))
    return pr_patches.join(last, "patch_id", "left").groupBy("pr_id").agg(
        F.when(F.coalesce(F.bool_or(~F.col("sound")), F.lit(False)), "failure").when(F.count_if(F.col("sound").isNull()) > 0, "neutral").otherwise("success").alias("conclusion")
    )


def tracked_packages(packages: DataFrame, repo_packages: DataFrame, repos: DataFrame) -> DataFrame:
    """Packages that an active repository depends on."""
    active = repo_packages.join(repos.where("is_active").select(F.col("id").alias("repo_id")), "repo_id", "left_semi")
    return packages.join(active.select(F.col("package_id").alias("id")), "id", "left_semi")


def package_access(packages: DataFrame, repo_packages: DataFrame, scope: DataFrame) -> DataFrame:
    """(user_id, package_id) of the packages that a visible repository (user_id, repo_id) depends on."""
    owned = repo_packages.join(packages.select(F.col("id").alias("package_id")), "package_id", "left_semi")
    return scope.join(owned, "repo_id").select("user_id", "package_id").distinct()


def version_patches(patches: DataFrame, usages: DataFrame, changes: DataFrame) -> DataFrame:
    """Verified patches by repository and package version, to be bundled in one pull request."""
    rows = patches.where("verified").select(F.col("id").alias("patch_id"), "code_usage_id").join(usages.select(F.col("id").alias("code_usage_id"), "repo_id", "detected_change_id"), "code_usage_id")
    return rows.join(changes.select(F.col("id").alias("detected_change_id"), F.col("package_id").alias("version_id")), "detected_change_id").select("repo_id", "version_id", "patch_id")


def file_incidents(incidents: DataFrame, files: DataFrame) -> DataFrame:
    """Incidents (id) that a file's list of change ids names: (repo_id, file_path, id)."""
    return files.select("repo_id", "file_path", F.explode(F.array_distinct("change_ids")).alias("id")).join(incidents, "id", "left_semi")


def open_pr_guard(prs: DataFrame, pr_patches: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches that no open pull request holds yet."""
    held = pr_patches.join(prs.where(F.col("status") == "open").select(F.col("id").alias("pr_id")), "pr_id", "left_semi")
    return patches.select(F.col("id").alias("patch_id")).join(held, "patch_id", "left_anti")


def of_incident(events: DataFrame, change_id: int) -> DataFrame:
    """What a client that watches one incident keeps: its events, and those of none."""
    return events.where(F.col("detected_change_id").isNull() | (F.col("detected_change_id") == change_id))
