"""The extraction of a change's files as views, for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import diffs, manifests
from ..sources.quarantine import register_functions


def register(spark: SparkSession, changes: str | None = None, diffs_view: str | None = None, prefix: str = "") -> list[str]:
    """Makes views of the session over a view of changed files (diff_id, ord, path, diff_hunk), or of diffs (diff_id, diff), and returns their names.

    ``dependency_changes``, ``suspicious_lines`` (diff_id, ord, path, line, label, text), ``notable_literals`` (diff_id, ord, path,
    literal); over diffs also ``file_changes``. They are plans like any view, so SQL's filters and columns reach the source. The
    table function ``archive_members`` is registered too.
    """
    register_functions(spark)
    names = []

    def add(name: str, rows) -> None:
        rows.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)

    if diffs_view is not None:
        files = diffs.file_changes(spark.table(diffs_view))
        add("file_changes", files)
    else:
        files = spark.table(changes)
    add("dependency_changes", manifests.dependency_changes(files))
    lines = files.select("diff_id", "ord", "path", F.explode(X.added_lines(F.col("diff_hunk"))).alias("a")).select("diff_id", "ord", "path", "a.line", "a.text")
    add("suspicious_lines", lines.select("diff_id", "ord", "path", "line", F.explode(X.suspicious_labels(F.col("text"))).alias("label"), "text"))
    add("notable_literals", files.select("diff_id", "ord", "path", F.explode(X.notable_literals(F.col("diff_hunk"))).alias("literal")))
    return names
