"""Unified diffs as rows: one per changed file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

MAX_DIFF_BYTES = 2 * 1024 * 1024
MAX_PAYLOAD_BYTES = 10 * 1024 * 1024


def read_diffs(spark: SparkSession, path: str, most: int = MAX_DIFF_BYTES) -> DataFrame:
    """(diff_id, diff, oversized): files with one diff each; what is over ``most`` bytes comes without its text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value"))
    big = F.octet_length("value") > most
    return raw.select("diff_id", F.when(~big, F.col("value")).alias("diff"), big.alias("oversized"))


def _path(raw):
    """A path without git's ``a/`` or ``b/``, time stamp and quotes; null for /dev/null."""
    clean = F.regexp_replace(F.regexp_replace(raw, r"\t.*$", ""), r'^"|"$', "")
    return F.when((clean != "/dev/null") & (clean != ""), F.regexp_replace(clean, r"^[ab]/", ""))


def file_changes(diffs: DataFrame, id_col: str = "diff_id", diff_col: str = "diff") -> DataFrame:
    """(diff_id, ord, path, old_path, status, diff_hunk, additions, deletions, is_binary, language).

    A file starts at a ``diff --git`` line or, in diffs without such lines, at a ``---`` line that a ``+++`` line
    follows. Null and empty texts have no files; text that is no diff has none either.
    """
    text = F.regexp_replace(F.coalesce(F.col(diff_col), F.lit("")), "\r\n", "\n")
    git = F.rlike(text, F.lit(r"(?m)^diff --git "))
    start = F.when(git, F.lit(r"(?m)(?=^diff --git )")).otherwise(F.lit(r"(?m)(?=^--- .*\n\+\+\+ )"))
    parts = diffs.select(F.col(id_col).alias("diff_id"), F.posexplode(F.split(text, start)).alias("at", "part")).filter(F.rlike("part", F.lit(r"(?m)\A(diff --git |--- .*\n\+\+\+ )")))
    head = F.regexp_extract("part", r"(?s)\A(.*?)(?=^@@|\z)".replace("(?s)", "(?sm)"), 1)
    get = lambda p: F.regexp_extract(head, "(?m)" + p, 1)
    minus, plus = _path(get(r"^--- (.*)$")), _path(get(r"^\+\+\+ (.*)$"))
    git_old, git_new = get(r'^diff --git "?a/(.*?)"? "?b/.*$'), get(r'^diff --git "?a/.*? "?b/(.*?)"?$')
    source, target = F.nullif(get(r"^rename from (.*)$"), F.lit("")), F.nullif(get(r"^rename to (.*)$"), F.lit(""))
    new = F.rlike(head, F.lit(r"(?m)^new file mode|^--- /dev/null"))
    deleted = F.rlike(head, F.lit(r"(?m)^deleted file mode|^\+\+\+ /dev/null"))
    renamed = source.isNotNull() | (minus.isNotNull() & plus.isNotNull() & (minus != plus))
    binary = F.rlike("part", F.lit(r"(?m)^Binary files .* differ$|^GIT binary patch$"))
    hunk = F.when(binary, "").otherwise(F.regexp_extract("part", r"(?sm)(^@@.*)\z", 1))
    rows = parts.select("diff_id", "at", "part", F.coalesce(target, plus, minus, F.nullif(git_new, F.lit("")), F.nullif(git_old, F.lit(""))).alias("path"), F.coalesce(source, minus).alias("from"), new.alias("new"), deleted.alias("deleted"), renamed.alias("renamed"), binary.alias("is_binary"), hunk.alias("diff_hunk"))
    added, gone = X.line_counts(F.col("diff_hunk"))
    status = X.change_status(F.col("new"), F.col("deleted"), F.col("renamed"))
    return rows.select(
        "diff_id",
        F.col("at").alias("ord"),
        "path",
        F.when((status == "renamed") & (F.col("from") != F.col("path")), F.col("from")).alias("old_path"),
        status.alias("status"),
        "diff_hunk",
        added.alias("additions"),
        gone.alias("deletions"),
        "is_binary",
        X.language(F.col("path")).alias("language"),
    ).filter("path IS NOT NULL")


def pushed_refs(lines: DataFrame, col: str = "value") -> DataFrame:
    """(old, new, ref, kind) of ``<old> <new> <ref>`` lines; shorter lines are dropped.

    kind: ``create`` if the old id is all zeros (the base is the empty tree), ``delete`` if the new one is (the diff is
    empty), else ``update``.
    """
    f = F.split(X.strip(F.col(col)), r"\s+")
    zeros = lambda c: F.rlike(c, F.lit("^0+$"))
    rows = lines.filter(F.size(f) >= 3).select(f[0].alias("old"), f[1].alias("new"), f[2].alias("ref"))
    return rows.withColumn("kind", F.when(zeros(F.col("new")), "delete").when(zeros(F.col("old")), "create").otherwise("update"))


def last_page(link):
    """The page number of the ``last`` relation of a Link header; null without one."""
    return F.nullif(F.regexp_extract(link, r'[?&]page=(\d+)[^>]*>;\s*rel="last"', 1), F.lit("")).cast("int")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Analysis requests as JSON lines; the repository is the explicit one, else the path's, else empty."""
    schema = "pr_id string, repo string, repo_path string, diff string, metadata string"
    rows = spark.read.schema(schema).json(path)
    repo = F.coalesce(F.nullif("repo", F.lit("")), F.nullif("repo_path", F.lit("")), F.lit(""))
    return rows.filter(F.octet_length(F.coalesce("diff", F.lit(""))) <= MAX_PAYLOAD_BYTES).withColumn("repo", repo)
