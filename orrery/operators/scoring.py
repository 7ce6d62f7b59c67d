"""Evidence to sub-scores, composite score and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Category weights in summing order, and the score without evidence.
WEIGHTS = (("structure", 0.30), ("dependency", 0.30), ("change_safety", 0.25), ("verification", 0.15))
NEUTRAL = 75


def clamp(score: Column) -> Column:
    """Rounded half to even, within 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score, 0))).cast("int")


def structure_score(cycles, hubs, orphan_ratio, unresolved, nodes) -> Column:
    base = F.lit(90.0) - F.least(F.lit(50.0), F.col(cycles) * 10.0) - F.col(hubs) * 5.0 - F.col(orphan_ratio) / 0.10 * 3.0
    return F.when(F.col(nodes) > 0, clamp(base + F.when(F.col(unresolved), 0.0).otherwise(10.0)))


def dependency_score(breaking, outdated, total) -> Column:
    return F.when((F.col(total) > 0) | (F.col(breaking) > 0), clamp(F.lit(100.0) - F.col(breaking) * 20.0 - F.col(outdated) * 5.0))


def safety_score(has_tests, has_ci, hubs) -> Column:
    return clamp(F.lit(100.0) - F.when(F.col(has_tests), 0.0).otherwise(15.0) - F.when(F.col(has_ci), 0.0).otherwise(10.0) - F.col(hubs) * 5.0)


def verification_score(merge_rate, pass_rate, open_prs, total) -> Column:
    known = (F.col(total) > 0) | F.col(merge_rate).isNotNull() | F.col(pass_rate).isNotNull()
    points = F.when(F.col(merge_rate) > 0.8, 20.0).otherwise(0.0) + F.when(F.col(pass_rate) > 0.9, 15.0).otherwise(0.0) - F.when(F.col(open_prs) > 3, 10.0).otherwise(0.0)
    return F.when(known, clamp(points + 70.0))


def composite_score(**sub_scores: str) -> Column:
    """Weighted mean of the scores that are there, 75 if none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS:
        score = F.col(sub_scores[name])
        total = total + F.coalesce(score * w, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, clamp(F.try_divide(total, weight))).otherwise(NEUTRAL)


def signals(repos: DataFrame, nodes: DataFrame, edges: DataFrame, degrees: DataFrame, cycles: DataFrame | None, usages: DataFrame, changes: DataFrame, prs: DataFrame, patches: DataFrame, runs: DataFrame, passive: tuple[str, ...]) -> DataFrame:
    """One wide row of evidence per repository.  Each table is aggregated before it is joined."""
    path = F.lower("path")
    lone = (F.col("fan_in") + F.col("fan_out") == 0) & ~F.coalesce(F.col("ext").isin(*passive), F.lit(False))
    shape = degrees.groupBy("repo_id").agg(
        F.count("*").alias("node_count"), F.count_if(F.col("fan_in") > 30).alias("critical_hubs"), F.max("fan_in").alias("max_fan_in"), F.count_if(lone).alias("orphans_count"),
        F.sum("unresolved").alias("unresolved_count"), F.min_by(F.struct("path", "fan_in", "fan_out"), F.struct(-F.col("fan_in"), "path")).alias("top_hub"),
        F.min(F.when(F.col("unresolved") > 0, F.struct("path", "unresolved"))).alias("first_unresolved"), F.coalesce(F.bool_or(path.contains("test") | path.contains("spec")), F.lit(False)).alias("has_tests"),
        F.coalesce(F.bool_or(F.col("path").startswith(".github/workflows/") & (F.col("path").endswith(".yml") | F.col("path").endswith(".yaml"))), F.lit(False)).alias("has_ci"),
    ).withColumn("critical_hubs", F.least("critical_hubs", F.lit(10)))
    first_word = F.coalesce(F.nullif(F.element_at(F.split(F.trim("description"), r"\s+"), 1), F.lit("")), F.lit("dependency"))
    pending = usages.where(F.col("status") == "pending").join(changes.select(F.col("id").alias("detected_change_id"), first_word.alias("package")), "detected_change_id")
    depends = pending.groupBy("repo_id").agg(F.count("*").alias("breaking_count"), F.countDistinct("package").alias("total_dependencies"), F.sort_array(F.collect_set("package")).alias("breaking_packages"))
    pulls = prs.groupBy("repo_id").agg(F.count("*").alias("total_prs"), F.count_if(F.col("merged") | (F.col("status") == "merged")).alias("merged_prs"), F.count_if(F.col("status") == "open").alias("open_prs"))
    outcomes = runs.where("tests_pass is not null").groupBy("patch_id").agg(F.count("*").alias("n"), F.count_if("tests_pass").alias("ok"))
    owner = patches.select(F.col("id").alias("patch_id"), "code_usage_id").join(usages.select(F.col("id").alias("code_usage_id"), "repo_id"), "code_usage_id")
    tested = outcomes.join(owner, "patch_id").groupBy("repo_id").agg(F.bround(F.sum("ok") / F.sum("n"), 3).alias("pass_rate"))
    rows = repos.select(F.col("id").alias("repo_id"), "full_name")
    for part in (shape, depends, pulls, tested, *([cycles.select("repo_id", "cycles_count", "sample_cycle")] if cycles is not None else [])):
        rows = rows.join(part, "repo_id", "left")
    zero = [c for c in rows.columns if c in ("node_count", "critical_hubs", "max_fan_in", "orphans_count", "unresolved_count", "breaking_count", "total_dependencies", "total_prs", "merged_prs", "open_prs", "cycles_count")]
    rows = rows.fillna(0, zero).fillna(False, ["has_tests", "has_ci"])
    return rows.withColumn("orphan_ratio", F.bround(F.col("orphans_count") / F.greatest(F.lit(1), "node_count"), 3)).withColumn("merge_rate", F.bround(F.try_divide(F.col("merged_prs").cast("double"), F.col("total_prs")), 3))


def scored(rows: DataFrame) -> DataFrame:
    """Evidence rows with the four sub-scores, the composite and the older risk score."""
    rows = rows.withColumn("has_unresolved", F.col("unresolved_count") > 0).withColumn("outdated", F.lit(0))
    rows = rows.withColumns({
        "structure": structure_score("cycles_count", "critical_hubs", "orphan_ratio", "has_unresolved", "node_count"),
        "dependency": dependency_score("breaking_count", "outdated", "total_dependencies"),
        "change_safety": safety_score("has_tests", "has_ci", "critical_hubs"),
        "verification": verification_score("merge_rate", "pass_rate", "open_prs", "total_prs"),
    })
    return rows.withColumn("score", composite_score(**{n: n for n, _ in WEIGHTS})).withColumn("risk_score", F.greatest(F.lit(0), 100 - F.col("score")))


# Titles, reasons and remedies of findings, in their order.
CYCLES = ("Circular dependency cycle detected ({} total)", "Cycle in module graph ({}) causes execution order race conditions and memory leaks.", "Refactor shared exports into a separate module to break the cycle at {}.")
BREAKING = ("{} upstream breaking changes pending patch validation", "Active runtime or signature discrepancies in imported dependencies threaten build stability.", "Review and merge automated synthetic AST patches generated by the engine.")
HUB = ("High fan-in architectural nexus: {}", "{} is imported by {} files. Any breaking modification propagates widely.", "Decouple core interfaces and protect with strict unit test coverage.")
UNTESTED = ("No automated test suite detected in repository", "Automated patch verification and regression prevention require test verification suites.", "Add test suites (e.g. pytest, vitest, jest) matching project runtime.")
NO_CI = ("GitHub Actions CI pipeline not configured", "Pushing changes without automated CI gates risks landing undetected breakage.", "Add a .github/workflows/ci.yml workflow for continuous verification.")
UNRESOLVED = ("{} unresolved static import specifiers", "Dynamic requires or missing alias path mappings limit static boundary analysis.", "Ensure tsconfig/jsconfig paths are synchronized and avoid dynamic imports in core files.")
HUB_FAN_IN, CYCLE_NAMES = 15, 4


def filled(template: str, *values: Column) -> Column:
    """The template with a value in place of each pair of braces."""
    pieces = template.split("{}")
    return F.concat(*(x for i, p in enumerate(pieces) for x in (F.lit(p), *([values[i].cast("string")] if i < len(pieces) - 1 else []))))


def _held() -> Column:
    """The rules that hold for a row of evidence, in fixed order: an array of at most one struct per rule."""
    cycle = F.split("sample_cycle", ",")
    names = F.array_join(F.transform(F.slice(cycle, 1, CYCLE_NAMES), lambda p: F.element_at(F.split(p, "/"), -1)), " → ")
    round_trip = F.concat(names, F.when(F.size(cycle) > CYCLE_NAMES, " …").otherwise(""))
    hub, gap, none = F.col("top_hub"), F.col("first_unresolved"), F.lit("")
    link = lambda path: F.concat(F.lit("?focus="), path)
    evidence = lambda **parts: F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())))

    def rule(n, hit, severity, title, evidence, why, what, link=none):
        return F.struct(F.lit(n).alias("rule"), F.coalesce(hit, F.lit(False)).alias("hit"), F.lit(severity).alias("severity"), title.alias("title"), evidence.alias("evidence"), why.alias("why"), what.alias("what"), link.alias("link"))

    rules = [
        rule(1, F.col("cycles_count") > 0, "critical", filled(CYCLES[0], F.col("cycles_count")), evidence(cycles_count=F.col("cycles_count"), sample_cycle=cycle), filled(CYCLES[1], round_trip), filled(CYCLES[2], cycle[0]), link(cycle[0])),
        rule(2, F.col("breaking_count") > 0, "critical", filled(BREAKING[0], F.col("breaking_count")), evidence(packages=F.col("breaking_packages"), count=F.col("breaking_count")), F.lit(BREAKING[1]), F.lit(BREAKING[2])),
        rule(3, hub["fan_in"] >= HUB_FAN_IN, "warning", filled(HUB[0], F.element_at(F.split(hub["path"], "/"), -1)), F.to_json(hub), filled(HUB[1], hub["path"], hub["fan_in"]), F.lit(HUB[2]), link(hub["path"])),
        rule(4, ~F.col("has_tests"), "warning", F.lit(UNTESTED[0]), F.lit('{"test_files_count":0}'), F.lit(UNTESTED[1]), F.lit(UNTESTED[2])),
        rule(5, ~F.col("has_ci"), "info", F.lit(NO_CI[0]), F.lit('{"ci_workflows":[]}'), F.lit(NO_CI[1]), F.lit(NO_CI[2])),
        rule(6, F.col("unresolved_count") > 0, "info", filled(UNRESOLVED[0], F.col("unresolved_count")), evidence(sample_file=gap["path"], specifiers=gap["unresolved"]), F.lit(UNRESOLVED[1]), F.lit(UNRESOLVED[2]), link(gap["path"])),
    ]
    return F.filter(F.array(*rules), lambda r: r["hit"])


def findings(rows: DataFrame) -> DataFrame:
    """The rules that hold for a repository, in fixed order, with evidence (JSON), reason, remedy and link into the graph."""
    return rows.select("repo_id", F.explode(_held()).alias("f")).select("repo_id", "f.*").drop("hit")


def with_findings(rows: DataFrame) -> DataFrame:
    """Evidence rows with their findings in an array, in fixed order; rows of no repository have none.

    What needs scores and findings together takes them from one row: a join of
    both would compute the evidence once for each side, all in the same task.
    """
    return rows.withColumn("found", F.when(F.col("repo_id").isNotNull(), _held()))


# The summary without a model, and what to do where nothing was found.
SUMMARY = "Repository {} scored {}/100 across architectural structure, dependency health, and change safety. {} actionable findings identified across {} files."
NOTHING_TO_DO = "Maintain continuous integration verification gates."


def summaries(scores: DataFrame, *kept: str | Column) -> DataFrame:
    """``scores``: repo_id, full_name, score, node_count, found.  (repo_id, executive_summary, do_this_first): the remedies of the first three findings; ``kept`` columns come along."""
    first = F.slice(F.filter(F.transform("found", lambda r: r["what"]), lambda w: w != ""), 1, 3)
    return scores.select(
        "repo_id", filled(SUMMARY, F.col("full_name"), F.col("score"), F.coalesce(F.array_size("found"), F.lit(0)), F.coalesce("node_count", F.lit(0))).alias("executive_summary"),
        F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(NOTHING_TO_DO))).alias("do_this_first"), *kept,
    )


def run_records(scores: DataFrame, head: str, now: Column) -> DataFrame:
    """Analysis runs to append: score, sub-scores and findings (column ``found``) as JSON, summary and first actions, with the commit in column ``head`` of ``scores``."""
    sub = F.to_json(F.struct(*(n for n, _ in WEIGHTS)), {"ignoreNullFields": "false"})
    listed = F.to_json(F.transform("found", lambda r: F.struct(r["severity"].alias("severity"), r["title"].alias("title"), r["what"].alias("what_to_do"))))
    rows = summaries(scores.where("repo_id is not null"), F.col(head).alias("head_sha"), "score", sub.alias("sub_scores"), F.coalesce(listed, F.lit("[]")).alias("findings"))
    return rows.select("repo_id", "head_sha", "score", "sub_scores", "findings", "executive_summary", "do_this_first", now.alias("created_at"))
