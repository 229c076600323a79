"""Who may see and change what, and the small listings around it: roles, block lists, organisations, cases, jobs, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..functions.staging import expanded, member_lists, spread
from ..sources import manifests
from .review import login


def role_listing(roles: DataFrame, monitored: DataFrame | None = None, repo: str | None = None) -> DataFrame:
    """(repo, user_login, role, monitor_type): by repository and login, or the logins of one repository.

    ``monitored`` (repo, ord, monitor_type) may have a repository several times; the first counts. Null where it isn't monitored.
    """
    rows = (roles if repo is None else roles.filter(F.col("repo") == repo)).select("repo", "user_login", "role")
    if monitored is None:
        rows = rows.withColumn("monitor_type", F.lit(None).cast("string"))
    else:
        rows = rows.join(monitored.groupBy("repo").agg(F.min_by("monitor_type", "ord").alias("monitor_type")), "repo", "left")
    return rows.orderBy("repo", "user_login")


def roles_of(roles: DataFrame, user: str, repo: str | None = None) -> DataFrame:
    """(repo, role) of one login, in its stored form, by repository; of one repository if it is given."""
    rows = roles.filter(login(F.col("user_login")) == user.strip().lower())
    return (rows if repo is None else rows.filter(F.col("repo") == repo)).select("repo", "role").orderBy("repo")


def without_roles(roles: DataFrame, keys: DataFrame) -> DataFrame:
    """``roles`` less those of ``keys`` (user_login, repo); logins are compared in their stored form."""
    gone = keys.select(login(F.col("user_login")).alias("_login"), "repo").distinct()
    return roles.withColumn("_login", login(F.col("user_login"))).join(gone, ["_login", "repo"], "left_anti").select(*roles.columns)


def block_list(blocked: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocked, refused): the block list (org_id, author_login, reason, blocked_by, blocked_at) after a log of requests, and its refusals.

    ``requests`` (org_id, ord, action add or remove, author_login, reason, by, at) are taken in the order of ``ord``. Refused, with
    ``why``: an empty login (empty), one that is blocked already (present), removing one that isn't blocked (absent). The state
    of an author before a request is what the request before left, whether that was refused or not: an add leaves the author
    blocked and a removal not. The entry of the old list comes before all requests; an entry, old or added, stays unless a
    removal follows. So one shuffle and one sort of an author's entries and requests decide all.
    """
    name = X.strip(F.coalesce("author_login", F.lit("")))
    add, old = F.col("action") == "add", F.col("_old")
    log = requests.filter(F.col("action").isin("add", "remove")).withColumn("author_login", name)
    empty = log.filter(add & (F.col("author_login") == "")).withColumn("why", F.lit("empty"))
    first = blocked.withColumns({"ord": F.lit(None).cast(requests.schema["ord"].dataType), "action": F.lit("add"), "_old": F.lit(True)}).withColumnsRenamed({"blocked_by": "by", "blocked_at": "at"})
    rows = spread(log.filter(F.col("author_login") != "").withColumn("_old", F.lit(False)).unionByName(first), "org_id", "author_login")
    order = Window.partitionBy("org_id", "author_login").orderBy(old.desc(), "ord")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_was": F.coalesce(F.lag(add).over(order), F.lit(False)), "_removed": F.max(F.when(~add, F.col("ord"))).over(every)})
    refused = rows.filter(~old & (add == F.col("_was"))).withColumn("why", F.when(add, "present").otherwise("absent")).select(*requests.columns, "why").unionByName(empty.select(*requests.columns, "why"))
    stays = rows.filter(add & (old | ~F.col("_was")) & (F.col("_removed").isNull() | (F.col("ord") > F.col("_removed"))))
    reason = F.when(old, F.col("reason")).otherwise(X.strip(F.coalesce("reason", F.lit(""))))
    return stays.withColumn("reason", reason).withColumnsRenamed({"by": "blocked_by", "at": "blocked_at"}).select(*blocked.columns), refused


def newest_blocked(blocked: DataFrame, org_id: Column | None = None) -> DataFrame:
    """The block list, of one organisation or all, the newest entries first."""
    rows = blocked if org_id is None else blocked.filter(F.col("org_id") == org_id)
    return rows.orderBy(F.col("blocked_at").desc(), "author_login")


def org_of_repos(repos: DataFrame, monitored: DataFrame) -> DataFrame:
    """(repo, org_id) of each of ``repos``: the organisation that monitors it, the first of several; null where none does."""
    return repos.select("repo").distinct().join(monitored.groupBy("repo").agg(F.min_by("org_id", "ord").alias("org_id")), "repo", "left")


def admin_scope(users: DataFrame, monitored: DataFrame, site_admins: str) -> DataFrame:
    """(user_login, repo): the repositories in a user's scope: those of the own organisation, or all for a site admin.

    ``users`` (user_login, org_id), ``site_admins``: logins separated by commas, in any case. A user without an organisation
    has no scope of it.

    Users with the same organisations are one class, whose repositories are made distinct before they meet its users: the
    result, which has many rows for each user, is never shuffled.
    """
    names = {x.strip().lower() for x in site_admins.split(",") if x.strip()}
    site = login(F.col("user_login")).isin(*names) if names else F.lit(False)
    all_repos = monitored.select("repo").distinct()
    groups = users.filter(~site & F.col("org_id").isNotNull()).groupBy("user_login").agg(F.array_sort(F.collect_set("org_id")).alias("_orgs"))
    orgs = groups.select("_orgs").distinct().select("_orgs", F.explode("_orgs").alias("org_id"))
    repos = orgs.join(monitored.select("org_id", "repo").distinct(), "org_id").select("_orgs", "repo").distinct()
    own = expanded(groups, member_lists(repos, "_orgs"), "_orgs")
    few = users.filter(site).select(login(F.col("user_login")).alias("user_login")).distinct().limit(max(len(names), 1))  # as many as there are names
    return own.unionByName(all_repos.crossJoin(F.broadcast(few)).select("user_login", "repo"))


def case_listing(cases: DataFrame) -> DataFrame:
    """Cases (case_id, title, ...) by title; of equal titles by id."""
    return cases.orderBy("title", "case_id")


def case_detail(cases: DataFrame, case_id: str) -> DataFrame:
    """One case, or none if the id isn't safe or unknown."""
    return cases.filter((F.col("case_id") == case_id) & F.rlike(F.lit(case_id), F.lit(K.CASE_ID)))


def job_part(value: Column) -> Column:
    """``value`` as part of a job's id: characters other than letters, digits, _ and - become _."""
    return F.regexp_replace(value, r"[^A-Za-z0-9_-]", "_")


def job_candidates(monitored: DataFrame, connections: DataFrame, default_token: str | None = None) -> DataFrame:
    """(id, repo, org_id, job_id, token) of the active repositories: their connection's token, or the default one."""
    tokens = connections.select(F.col("id").alias("vcs_connection_id"), F.when(F.coalesce("access_token", F.lit("")) != "", F.col("access_token")).alias("own"))
    rows = monitored.filter("status = 'active'").join(tokens, "vcs_connection_id", "left")
    return rows.select("id", "repo", "org_id", F.concat(F.lit("poll_"), job_part(F.col("repo"))).alias("job_id"), F.coalesce("own", F.lit(default_token)).alias("token"))


def poll_outcomes(monitored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``monitored`` with last_polled_at, consecutive_errors and status after ``outcomes`` (id, ord, at, success).

    Errors count from the last success on; the fifth in a row at any time sets the status to ``error``. A repository without
    outcomes stays as it is.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = outcomes.join(monitored.select("id", F.col("consecutive_errors").alias("_old")), "id")
    run = F.sum(F.col("success").cast("int")).over(order)
    rows = joined.withColumn("_run", run).withColumn("_n", F.row_number().over(Window.partitionBy("id", "_run").orderBy("ord")))
    errors = F.when(F.col("_run") == 0, F.col("_old") + F.col("_n")).otherwise(F.col("_n") - 1)
    rows = rows.withColumn("_errors", errors.cast("int"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("at", "_errors"), "ord").alias("_l"), F.max("_errors").alias("_most"))
    return (
        monitored.join(last, "id", "left")
        .withColumn("last_polled_at", F.coalesce("_l.at", "last_polled_at"))
        .withColumn("consecutive_errors", F.coalesce("_l._errors", "consecutive_errors"))
        .withColumn("status", F.when(F.col("_most") >= K.MOST_POLL_ERRORS, "error").otherwise(F.col("status")))
        .select(*monitored.columns)
    )


def safe_registry_ids(manifest: Column) -> Column:
    """The entries of a manifest's ``official_registry_configs`` that are texts of a safe form; none if it isn't such a list."""
    entries = F.from_json(F.get_json_object(manifest, "$.official_registry_configs"), "array<string>")
    # texts only: the list without its texts is read a second time as plain JSON to tell "1" from 1
    raw = F.from_json(F.get_json_object(manifest, "$.official_registry_configs"), "array<variant>")
    texts = F.transform(F.zip_with(entries, raw, lambda e, v: F.struct(e.alias("e"), F.schema_of_variant(v).alias("k"))), lambda x: F.when(x["k"] == "STRING", x["e"]))
    return F.coalesce(F.filter(texts, lambda e: F.coalesce(F.rlike(e, F.lit(K.REGISTRY_ID)), F.lit(False))), F.array().cast("array<string>"))


def finding_type(metadata: Column, options: Column) -> Column:
    """The declared type of a rule's findings, in lower case: from its metadata (a map), else its options; null without one."""
    said = lambda block: F.when(F.element_at(block, F.lit("finding_type")) != "", F.element_at(block, F.lit("finding_type")))
    return F.lower(X.strip(F.coalesce(said(metadata), said(options))))


def path_version(version: Column) -> Column:
    """A version as part of a path: characters other than letters, digits, _, . and - become _; ``unknown`` if nothing is left."""
    cleaned = F.regexp_replace(X.strip(version), r"[^A-Za-z0-9_.-]", "_")
    return F.when(F.coalesce(cleaned, F.lit("")) != "", cleaned).otherwise(F.lit("unknown"))


def ttl_seconds(value: Column, default: int) -> Column:
    """A time to live that a setting states; the default if it isn't a whole number over 0."""
    n = X.strip(value).try_cast("long")
    return F.when(n > 0, n).otherwise(F.lit(default).cast("long"))


def python_dependencies(changes: DataFrame) -> DataFrame:
    """(diff_id, ord, name, ecosystem): packages that a change adds to requirements files of any name."""
    wanted = changes.filter(F.rlike("path", F.lit(K.REQUIREMENTS_PATH)))
    named = wanted.select("diff_id", "ord", F.lit("requirements.txt").alias("path"), "diff_hunk")
    found = manifests.dependency_changes(named)
    return found.filter("name <> ''").select("diff_id", F.col("file_ord").alias("ord"), "name", F.lit("PyPI").alias("ecosystem"))


def fragments_of(hits: DataFrame, default_origin: str) -> DataFrame:
    """(query, rank, text, case_name, origin, verdict): retrieved pieces with defaults for what their metadata (a map) lacks."""
    at = lambda k: F.element_at("meta", F.lit(k))
    return hits.select("query", "rank", "text", F.coalesce(at("case_name"), F.lit(K.UNKNOWN)).alias("case_name"), F.coalesce(at("origin"), F.lit(default_origin)).alias("origin"), F.when(at("verdict") != "", at("verdict")).alias("verdict"))


def overview_text(modules: DataFrame, most: int = K.OVERVIEW_MODULES) -> DataFrame:
    """(repo, modules): a line for each of the first ``most`` modules (repo, place, name, file_count, category, summaries) of a repository."""
    line = F.concat(F.lit("- "), "name", F.lit("/ ("), F.col("file_count").cast("string"), F.lit(", "), "category", F.lit("): "), F.array_join("summaries", " · "))
    rows = modules.filter(F.col("place") <= most).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return rows.select("repo", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("modules"))
