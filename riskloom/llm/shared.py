"""Helpers that several operators use: shared storage, size-checked joins, batch slicing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Groups with more than 1/HOT_SHARE of all rows are joined by broadcast: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where none is configured and all run on one machine."""
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


def staged(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: cuts lineage, survives lost executors.

    Nothing reads the plan's shuffle files again; if they are ``large``, Spark is told to delete them once
    it is written. A large table holds hashes, for which dictionaries only cost time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskloom/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true" if large else before)
    try:
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not large).lower()).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, and lets go of the driver's plans of finished steps."""
    for t in tables:
        delete(t.sparkSession, t._staged_at)
        t._staged_at = None
    gc.collect()


def partitions_for(rows: int, each: int) -> int:
    """As many partitions as hold ``each`` rows (or bytes), at least 8: their number grows with the data, a task does not."""
    return max(8, -(-rows // each))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Gives each row what its group has (one row of ``groups`` for each key, with the group's ``size``).

    Groups with more than 1/HOT_SHARE of all ``total`` rows are fewer than HOT_SHARE, so they are broadcast;
    all others meet in a shuffled join without a hot key.
    """
    bound = max(total // HOT_SHARE, 1)
    hot = F.broadcast(groups.filter(F.col(size) > bound))
    cold = groups.filter(F.col(size) <= bound)
    return rows.join(hot, key, "inner").unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key, "inner"))


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole texts of about ``most`` bytes (one longer text is a run of its own).

    Yields (first row, row after the last, bytes as uint8, offsets of the texts in these bytes). Null is the empty text.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] > 0 else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column), lo + 20_000)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def combined(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def batches(arrays: Iterable[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names=names)
