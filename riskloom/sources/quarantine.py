"""Bad records beside good ones: what can't be taken goes to a second table with the reason, the rest goes on."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .diffs import MAX_PAYLOAD_BYTES

#: Bytes of an archive's members that one batch of rows holds, about.
_BATCH_BYTES = 8 << 20
MEMBERS = "path string, text string, n_bytes long, reason string"


def with_text(rows: DataFrame, data_col: str = "content", most: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """Adds text, n_bytes and reason: why a record's bytes can't be taken (missing, too_large, not_utf8), null if they can.

    The text is null where there is a reason. A text that starts with ``Binary files `` is a diff's note and no reason.
    """
    size = F.octet_length(data_col)
    small = F.when(size <= most, F.col(data_col).cast("string"))
    reason = F.when(F.col(data_col).isNull(), "missing").when(size > most, "too_large").when(~F.is_valid_utf8(small), "not_utf8")
    return rows.withColumns({"n_bytes": size.cast("long"), "reason": reason, "text": F.when(reason.isNull(), small)})


def split(rows: DataFrame, id_cols: list[str], data_col: str = "content", most: int = MAX_PAYLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good rows have their columns and text; bad ones ids, n_bytes and reason. Each row is in one of them."""
    judged = with_text(rows, data_col, most)
    return judged.filter("reason IS NULL").drop(data_col, "n_bytes", "reason"), judged.filter("reason IS NOT NULL").select(*id_cols, "n_bytes", "reason")


def read_files(spark: SparkSession, path: str, most: int = MAX_PAYLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(good, bad) files under ``path``: (path, text) and (path, n_bytes, reason). What is too large isn't read. Spark doesn't list files of no bytes."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= most, F.col("content")).alias("content"))
    big = raw.filter(F.col("length") > most).select("path", F.col("length").alias("n_bytes"), F.lit("too_large").alias("reason"))
    good, bad = split(raw.filter(F.col("length") <= most).select("path", "content"), ["path"])
    return good, bad.unionByName(big)


def members(data: bytes, most: int = MAX_PAYLOAD_BYTES) -> Iterator[tuple[str, str | None, int, str | None]]:
    """(path, text, n_bytes, reason) of each file in a tar archive, plain or compressed, one after the other.

    Reasons: unsafe_path (absolute, or out of the archive), too_large, not_utf8; an archive that can't be read to its end gives
    the members before and one row with an empty path and the reason broken. Folders and links aren't files.
    """
    if not data:
        yield "", None, 0, "broken"
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as tar:  # a stream: no index of all members is held
            for m in tar:
                if not m.isfile():
                    continue
                if m.name.startswith("/") or ".." in m.name.split("/"):
                    yield m.name, None, m.size, "unsafe_path"
                elif m.size > most:
                    yield m.name, None, m.size, "too_large"
                else:
                    try:
                        yield m.name, tar.extractfile(m).read().decode("utf-8"), m.size, None
                    except UnicodeDecodeError:
                        yield m.name, None, m.size, "not_utf8"
    except (tarfile.TarError, EOFError, OSError, ValueError):
        yield "", None, 0, "broken"


def archive_files(archives: DataFrame, id_col: str = "archive", data_col: str = "content", most: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """(archive, path, text, n_bytes, reason): the members of each archive (see ``members``); rows leave a task in small batches."""
    rows = archives.select(F.col(id_col).alias("archive"), F.col(data_col).alias("content"))
    kind = rows.schema["archive"].dataType.simpleString()

    def batch(owner: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)
        return pa.RecordBatch.from_arrays([owner.take(pa.array([0] * len(found))), *(pa.array(c, k) for c, k in columns)], names=["archive", "path", "text", "n_bytes", "reason"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                owner, found, held = part.column(0).slice(i, 1), [], 0
                for m in members(part.column(1)[i].as_py() or b"", most):
                    found.append(m)
                    held += m[2]
                    if held > _BATCH_BYTES:
                        yield batch(owner, found)
                        found, held = [], 0
                if found:
                    yield batch(owner, found)

    return rows.mapInArrow(run, f"archive {kind}, {MEMBERS}")


def read_archives(spark: SparkSession, path: str, most: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """``archive_files`` of the archives under ``path``; an archive is named by its path."""
    return archive_files(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"), most=most)


def register_functions(spark: SparkSession) -> None:
    """``archive_members(data)`` as a table function in SQL, to be used with LATERAL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=MEMBERS)
    class ArchiveMembers:
        def eval(self, data: bytes):
            yield from members(bytes(data) if data is not None else b"")

    spark.udtf.register("archive_members", ArchiveMembers)
