"""Webhook payloads as rows: JSON lines to pushes, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import iso_time

NO_COMMIT = "0" * 40
LARGE_PUSH = 20  # commits from which a push counts as truncated
COMMITS = "array<struct<id:string,added:array<string>,modified:array<string>,removed:array<string>>>"
PUSH = f"struct<ref:string,before:string,after:string,truncated:boolean,head_commit:struct<id:string,timestamp:string>,commits:{COMMITS},repository:struct<id:long,full_name:string,default_branch:string>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Column ``value``: one payload a line."""
    return spark.read.text(path)


def line_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream of the files that come into the folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def pushes(payloads: DataFrame, column: str = "value") -> DataFrame:
    """(repo_id, full_name, ref, default_branch, before, after, truncated, commits, at) of push payloads.

    What is no JSON, or names no repository, is left out.  A missing default
    branch is ``main``; a new commit is ``after``, else the head commit's id; the
    null commit before counts as none; 20 commits or more count as truncated.
    """
    rows = payloads.select(F.from_json(F.col(column), PUSH).alias("p")).where("coalesce(p.repository.id, 0) <> 0")
    commits = F.coalesce("p.commits", F.array().cast(COMMITS))
    return rows.select(
        F.col("p.repository.id").alias("repo_id"), F.col("p.repository.full_name").alias("full_name"), F.coalesce("p.ref", F.lit("")).alias("ref"), F.coalesce("p.repository.default_branch", F.lit("main")).alias("default_branch"),
        F.nullif("p.before", F.lit(NO_COMMIT)).alias("before"), F.coalesce(F.nullif("p.after", F.lit("")), F.col("p.head_commit.id"), F.lit("")).alias("after"),
        (F.coalesce("p.truncated", F.lit(False)) | (F.size(commits) >= LARGE_PUSH)).alias("truncated"), commits.alias("commits"), iso_time(F.col("p.head_commit.timestamp")).alias("at"),
    )
