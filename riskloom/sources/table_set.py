"""Sets of Parquet tables under one folder that change together.

Each commit writes the tables that change into new folders and then one small manifest, which says where every table of that
version lies. A version counts once its manifest has its final name; the rename is atomic and fails if another commit took
the number first. So readers see all of a commit or nothing of it, and a commit that breaks off leaves the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import login


class Conflict(RuntimeError):
    """Another commit was made since the version that this one started from."""


class TableSet:
    """The tables under ``base``, a folder in any store that Spark's Hadoop client knows. Readers keep the version they opened."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.version, self.paths = self._latest()

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict[str, str]]:
        found = self._fs().globStatus(self._path(f"{self.base}/manifests/v*.json"))
        names = [s.getPath().getName() for s in found or []]
        versions = [int(n[1:-5]) for n in names if n[1:-5].isdigit()]
        if not versions:
            return 0, {}
        last = max(versions)
        return last, json.loads(self.spark.read.text(f"{self.base}/manifests/v{last}.json", wholetext=True).first()[0])

    def names(self) -> list[str]:
        return sorted(self.paths)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{self.paths[name]}")

    def commit(self, changes: dict[str, DataFrame], after_write: Callable[[str], None] = lambda name: None) -> TableSet:
        """A new version with ``changes`` in place of the tables of these names; the others stay. Raises ``Conflict`` if one came between.

        ``after_write`` is called with the name of each table once it is written, before the version counts.
        """
        paths = dict(self.paths)
        for name, rows in changes.items():
            paths[name] = f"data/{uuid.uuid4().hex}/{name}"
            rows.write.parquet(f"{self.base}/{paths[name]}")
            after_write(name)
        fs, jvm = self._fs(), self.spark._jvm
        fs.mkdirs(self._path(f"{self.base}/manifests"))
        own, final = self._path(f"{self.base}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.base}/manifests/v{self.version + 1}.json")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(paths, sort_keys=True).encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(own, final, plain)
        except Exception as e:
            fs.delete(own, False)
            if fs.exists(final):
                raise Conflict(f"version {self.version + 1} exists already") from e
            raise
        return TableSet(self.spark, self.base)

    def unused(self) -> list[str]:
        """Folders that no version's manifest names, such as those of commits that broke off. For a job that tidies up."""
        named: set[str] = set()
        for s in self._fs().globStatus(self._path(f"{self.base}/manifests/v*.json")) or []:
            named |= {p.split("/")[1] for p in json.loads(self.spark.read.text(s.getPath().toString(), wholetext=True).first()[0]).values()}
        found = self._fs().globStatus(self._path(f"{self.base}/data/*"))
        return sorted(s.getPath().getName() for s in found or [] if s.getPath().getName() not in named)


#: Tables with a repository's data, and the column that names it. Blocks of authors belong to organisations and stay.
REPO_TABLES = {"scores": "repo", "roles": "repo", "settings": "repo", "edges": "repo", "nodes": "repo", "summaries": "repo", "api_keys": "repo", "monitored": "repo"}


def without_repos(tables: TableSet, repos: DataFrame) -> dict[str, DataFrame]:
    """What a commit needs to delete all data of ``repos`` (repo): every table of ``REPO_TABLES`` that the set has, less their rows."""
    gone = repos.select("repo").distinct()
    return {t: tables.read(t).join(gone.withColumnRenamed("repo", c), c, "left_anti").select(*tables.read(t).columns) for t, c in REPO_TABLES.items() if t in tables.paths}


def without_users(tables: TableSet, logins: DataFrame) -> dict[str, DataFrame]:
    """What a commit needs to delete accounts (user_login): the accounts and all their roles. Logins are compared in their stored form."""
    gone = logins.select(login(F.col("user_login")).alias("_login")).distinct()
    less = lambda rows: rows.withColumn("_login", login(F.col("user_login"))).join(gone, "_login", "left_anti").select(*rows.columns)
    return {t: less(tables.read(t)) for t in ("users", "roles") if t in tables.paths}
