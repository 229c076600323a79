"""Materialised steps of long plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Members of one list of a group, at most. Generated code holds the pairs of two lists at once, 40,000 rows; two lists of 1000 filled the heap.
LIST_ROWS = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Checkpoints into the shared folder of the session (see ``shared_dir``), so that later steps plan from here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt to as many tasks as a shuffle has, by ``keys`` or in turn.

    For rows that are small when they are read and costly afterwards: a file of a few MB is one task, however many rows it has.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def member_lists(rows: DataFrame, key: str) -> DataFrame:
    """(key, members): the other columns of each key's rows as lists of up to ``LIST_ROWS`` structs; a large group has several lists."""
    rest = [c for c in rows.columns if c != key]
    at = F.row_number().over(Window.partitionBy(key).orderBy(*rest))
    return spread(rows, key).withColumn("_list", F.floor((at - 1) / LIST_ROWS)).groupBy(key, "_list").agg(F.collect_list(F.struct(*rest)).alias("members")).drop("_list")


def expanded(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with each member of their group (``member_lists``) in place of ``key``.

    Lists of rows meet lists of members, and these pairs of lists are dealt to all tasks in turn. The pairs of single rows, which
    may be far more, are only made there, in the last step: a group with most of the pairs is no longer task than others, and
    few bytes are no reason to take few tasks.
    """
    kept = [c for c in rows.columns if c != key]
    lists = member_lists(rows, key).withColumnRenamed("members", "_rows")
    both = spread(lists.join(groups, key).select("_rows", "members"))
    return both.select(F.explode("_rows").alias("_r"), "members").select(*(F.col("_r")[c].alias(c) for c in kept), F.explode("members").alias("_m")).select(*kept, "_m.*")
