"""Exact deduplication over a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest, one row for each distinct text ever accepted. A
batch is reduced to one row per digest (partial aggregation before the shuffle, so a hot text costs one row per
task), anti-joined with the index by a sort-merge join and the rest appended. The index notes which batch brought a
text, so a batch that is judged again, because its result was lost after the append, gets the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, join_groups, staged

BUCKETS = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the whole text in UTF-8; null counts as the empty text."""
    return docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))


def open_index(spark: SparkSession, table: str, path: str | None = None, buckets: int = BUCKETS) -> None:
    """Creates the index table, or registers the one that lies at ``path`` already."""
    where = f"LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {where}")


def batch_name(rows: DataFrame) -> str:
    """A name that follows from the rows (id, digest) of a batch: the same rows, in any order, have the same name."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("id", "digest").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}:{total}"


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of ``rows`` (id, digest): partial aggregation first, so a hot text is a row for each task."""
    return staged(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")


def append_new(spark: SparkSession, groups: DataFrame, table: str, batch: str, buckets: int = BUCKETS) -> DataFrame:
    """Appends the texts that the index lacks; returns those, with those that an earlier run of the same batch brought (``own``)."""
    known = spark.table(table).select("digest", (F.col("batch") == batch).alias("own"))
    fresh = groups.join(known.hint("merge"), "digest", "left").filter(F.coalesce("own", F.lit(True)))
    fresh = staged(fresh, "fresh")  # read before the table is written to
    new = fresh.filter("own IS NULL").select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
    # dealt by bucket, so that each bucket is one file of a batch, whatever the number of partitions
    dealt = new.withColumn("_bucket", F.pmod(F.hash("digest"), F.lit(buckets))).repartition(2 * buckets, "_bucket").sortWithinPartitions("_bucket", "digest").drop("_bucket")
    dealt.write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").mode("append").saveAsTable(table)
    return fresh


def add_batch(spark: SparkSession, rows: DataFrame, table: str, batch: str, buckets: int = BUCKETS) -> DataFrame:
    """Appends the texts of ``rows`` (id, digest) that the index lacks; returns a row for each digest of the batch.

    Texts that the index has from a run of the same ``batch`` are its own: not appended again, and not ``known``.

    Of equal texts in the batch, the largest id is the one to keep (ids that are null lose). The returned
    ``known`` says that an earlier batch brought the digest; no row of this batch is to be kept then.
    """
    groups = grouped(rows)
    fresh = append_new(spark, groups, table, batch, buckets)
    judged = groups.join(fresh.select("digest", F.lit(False).alias("known")).hint("merge"), "digest", "left").withColumn("known", F.coalesce("known", F.lit(True)))
    judged = staged(judged, "judged")
    discard(groups, fresh)
    return judged


def dedup(spark: SparkSession, docs: DataFrame, table: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, batch: str | None = None) -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept.

    ``batch`` names the documents as one batch; unless given, the name follows from their ids and texts. A batch of
    the same name is a rerun and gets the verdicts of the first run. Null texts equal empty ones; an empty table gives no rows; other columns are not read, so clashing names do
    no harm. Rows that repeat an id with the same text all carry that id's verdict. A row with a null id is kept
    only if its whole group has null ids.
    """
    rows = staged(digests(docs, id_col, text_col), "digests")
    groups = add_batch(spark, rows, table, batch or batch_name(rows), buckets)
    old = spark.table(table).select("digest", F.col("keep_id").alias("old_id"))
    known = groups.filter("known").join(old.hint("merge"), "digest", "left").select("digest", F.col("old_id").alias("keep_id"), "group_size", "known")
    all_groups = groups.filter(~F.col("known")).unionByName(known)
    joined = join_groups(rows, all_groups, "digest", "group_size", rows.count())
    return joined.select("id", "digest", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"))


def by_descending_id(rows: DataFrame, batches: int) -> list[DataFrame]:
    """``rows`` (id, ...) cut into ranges of ids of equal width, the largest ids first; null ids are in the last one."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return [rows]
    width = -(-(high - low + 1) // batches)
    nth = F.coalesce(F.expr(f"({high}L - id) div {width}L"), F.lit(batches - 1))
    return [rows.filter(nth == k) for k in range(batches)]


def dedup_batches(spark: SparkSession, docs: DataFrame, table: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, batches: int = 2) -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept, with the documents added to a new index batch by batch.

    Batches come in descending order of whole-number ids, so of equal texts the first one that the index gets has the largest id:
    it stays, and every later batch is anti-joined with the texts that the batches before brought. ``keep_id`` is the index's,
    ``group_size`` counts all batches. Nulls, repeated rows and empty tables are as in ``dedup``. The result doesn't need the
    index table any more.
    """
    rows = staged(digests(docs, id_col, text_col), "digests")
    brought = []
    for k, part in enumerate(by_descending_id(rows, batches)):
        brought.append(grouped(part))
        discard(append_new(spark, brought[-1], table, f"batch {k}", buckets))
    every = brought[0]
    for more in brought[1:]:
        every = every.unionByName(more)
    sizes = every.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    groups = staged(sizes.join(spark.table(table).select("digest", "keep_id").hint("merge"), "digest"), "verdicts")
    discard(*brought)
    joined = join_groups(rows, groups, "digest", "group_size", rows.count())
    return joined.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
