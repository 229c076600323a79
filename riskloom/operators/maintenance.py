"""Retention, updates and settings over tables that are rewritten or read as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def purge(scores: DataFrame, cutoff: str) -> DataFrame:
    """Rows that retention keeps: ISO times compared as text, strictly older ones go."""
    return scores.filter(F.col("ts") >= cutoff)


def without_repo(table: DataFrame, repo: str) -> DataFrame:
    return table.filter(F.col("repo") != repo)


def cascade(repo: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of a repository."""
    return {name: without_repo(t, repo) for name, t in tables.items()}


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key in an append-only log: how upserts, feedback and approvals are read."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def close_changes(scores: DataFrame, closed: DataFrame) -> DataFrame:
    """Sets state ``closed`` where it is ``open`` and ``closed`` (repo, pr_number) names the row; number 0 never closes."""
    names = closed.filter("pr_number <> 0").select("repo", "pr_number").distinct().withColumn("gone", F.lit(True))
    joined = scores.join(names, ["repo", "pr_number"], "left")
    return joined.withColumn("state", F.when((F.col("state") == "open") & F.col("gone"), "closed").otherwise(F.col("state"))).drop("gone")


def add_usage(usage: DataFrame, deltas: DataFrame) -> DataFrame:
    """(user_id, month, org_id, tokens_used): amounts added up; the first known organisation stays."""
    both = usage.withColumn("o", F.lit(0)).unionByName(deltas.withColumn("o", F.lit(1)))
    return both.groupBy("user_id", "month").agg(F.min_by("org_id", F.when(F.col("org_id").isNotNull(), F.col("o"))).alias("org_id"), F.sum("tokens_used").alias("tokens_used"))


def insert_unseen(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``new`` to append: keys that the table lacks in any state, the first of equal ones."""
    first = new.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("n = 1").drop("n")
    return first.join(table.select(key).distinct(), key, "left_anti")


def effective_settings(repos: DataFrame, repo_settings: DataFrame, org_settings: DataFrame, defaults: dict) -> DataFrame:
    """Each setting from the repository, else its organisation, else the default."""
    r = repo_settings.select("repo", *(F.col(k).alias(f"r_{k}") for k in defaults))
    o = org_settings.select("org", *(F.col(k).alias(f"o_{k}") for k in defaults))
    return repos.join(r, "repo", "left").join(o, "org", "left").select("repo", "org", *(F.coalesce(f"r_{k}", f"o_{k}", F.lit(v)).alias(k) for k, v in defaults.items()))


def visible_repos(roles: DataFrame, monitored: DataFrame, user: str) -> DataFrame:
    """Repositories that a user has a role in, or whose organisation they belong to: distinct, in order."""
    direct = roles.filter(F.col("user_id") == user).select("repo")
    orgs = roles.filter((F.col("user_id") == user) & F.col("org").isNotNull()).select("org").distinct()
    return direct.union(monitored.join(orgs, "org", "left_semi").select("repo")).filter("repo IS NOT NULL").distinct().orderBy("repo")


def at_least(role, needed: str):
    """Whether a role is as high as ``needed``: viewer, reviewer, admin."""
    rank = lambda c: F.when(c == "viewer", 1).when(c == "reviewer", 2).when(c == "admin", 3).otherwise(0)
    return rank(role) >= rank(F.lit(needed))


def fresh(cache: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Cache rows younger than ``hours`` at the time ``now``."""
    return cache.filter(F.col("fetched_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def missing_columns(table: DataFrame, expected: dict[str, str]) -> list[str]:
    """Columns of the expected schema that a stored table lacks."""
    return [c for c in expected if c not in table.columns]
