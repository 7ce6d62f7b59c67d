"""Tenant scope: which repositories a user sees, and what an access attempt gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def visible_repos(repos: DataFrame, installations: DataFrame, users: DataFrame, operators: tuple[int, ...] = ()) -> DataFrame:
    """(user_id, repo_id): the user installed the app, or the account bears the user's login, in any case; operators see all."""
    owned = repos.select(F.col("id").alias("repo_id"), "installation_id").join(installations.select(F.col("id").alias("installation_id"), "installed_by", F.lower("account_login").alias("account")), "installation_id")
    by_id = owned.join(users.select(F.col("id").alias("user_id")), F.col("installed_by") == F.col("user_id")).select("user_id", "repo_id")
    by_login = owned.join(users.select(F.col("id").alias("user_id"), F.lower("login").alias("account")), "account").select("user_id", "repo_id")
    every = by_id.union(by_login)
    for operator in operators:
        every = every.union(repos.select(F.lit(operator).cast(users.schema["id"].dataType).alias("user_id"), F.col("id").alias("repo_id")))
    return every.distinct()


def access_outcome(asked: DataFrame, repos: DataFrame, visible: DataFrame) -> DataFrame:
    """``asked``: (user_id, repo_id).  404 for an unknown repository, 403 for one out of scope, else 200."""
    known = repos.select(F.col("id").alias("repo_id"), F.lit(True).alias("known"))
    seen = visible.withColumn("seen", F.lit(True))
    return asked.join(known, "repo_id", "left").join(seen, ["user_id", "repo_id"], "left").select("user_id", "repo_id", F.when(F.col("known").isNull(), 404).when(F.col("seen").isNull(), 403).otherwise(200).alias("outcome"))
