"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Every benchmark item gives windows of ``size`` consecutive words. The windows of one length form a pattern set
with a shift table over blocks of two words: a block that no pattern has skips as far as a pattern's length
allows. A block that may end a pattern selects a bucket of patterns, and direct comparison confirms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import combined, discard, staged

#: Benchmark text is searched in blocks of about so many bytes; a worker's tables take about a hundred times that.
BLOCK_BYTES = 1 << 20

#: Lower-cases A-Z; all but 0-9, a-z and bytes over 0x7F become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text; null has none."""
    return (text or "").encode().translate(_TABLE).split()


class PatternSet:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.items = length, patterns
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[p[length - self.block :]].append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(first word, pattern) for each occurrence."""
        block, far, get, n, end = self.block, self.far, self.shift.get, len(words), self.length
        while end <= n:
            key = tuple(words[end - block : end])
            skip = get(key, far)
            if skip:
                end += skip
                continue
            here = tuple(words[end - self.length : end])
            for p in self.bucket[key]:
                if p == here:
                    yield end - self.length, p
            end += 1


def pattern_sets(items: list[tuple[str, str | None]], size: int) -> list[PatternSet]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length[n][tuple(words[i : i + n])].append(item)
    return [PatternSet(n, p) for n, p in sorted(by_length.items())]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of about ``most`` bytes, however large it is: the driver holds one at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // most))
    for k in range(parts):
        yield [(r.item, r.text) for r in (rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else rows).toLocalIterator() if r.item is not None]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and ``_hit`` (sorted positions of hit words), ``_items`` (ids as sorted strings), ``_n_words``.

    No shuffle: the documents stay where they are read. Each block of the benchmark is broadcast for one pass over
    them; of several passes each but the last is written to the shared folder before the next block is read, so driver
    and workers hold one block at a time. A null or empty text has no words; a null item text or id has no windows; an
    empty benchmark hits nothing; rows that repeat an id are judged row by row. Columns of ``docs`` may have any names
    other than these three.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("_hit", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_n_words", T.LongType())])
    out = docs.withColumns({"_hit": F.array().cast("array<int>"), "_items": F.array().cast("array<string>"), "_n_words": F.lit(0).cast("long")})
    block, before = None, None
    for following in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        if block is not None:
            out = staged(out, "searched")
            block.unpersist()
            if before is not None:
                discard(before)
            before = out
        block = docs.sparkSession.sparkContext.broadcast(following)
        out = _pass(out, schema, block, text_col, size)
    return out


def _pass(docs: DataFrame, schema: T.StructType, block: Broadcast, text_col: str, size: int) -> DataFrame:
    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = pattern_sets(block.value, size)
        for part in parts:
            for batch in (part.slice(i, 500) for i in range(0, part.num_rows, 500)):
                hits, items, counts = [], [], []
                old_hits, old_items = combined(batch, "_hit").to_pylist(), combined(batch, "_items").to_pylist()
                for text, hit, item in zip(combined(batch, text_col).to_pylist(), old_hits, old_items, strict=True):
                    words, found, new = words_of(text), set(item), []
                    for s in sets:
                        for at, p in s.find(words):
                            new.append((at, s.length))
                            found.update(s.items[p])
                    if new:
                        mark = np.zeros(len(words), bool)
                        mark[hit] = True
                        for at, n in new:
                            mark[at : at + n] = True
                        hit = np.flatnonzero(mark)
                    hits.append(hit)
                    items.append(sorted(found))
                    counts.append(len(words))
                keep = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("_hit", "_items", "_n_words")]
                names = [n for n in batch.schema.names if n not in ("_hit", "_items", "_n_words")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64())], names=[*names, "_hit", "_items", "_n_words"])

    return docs.mapInArrow(search, schema)


def contaminated(hit: F.Column, n_words: F.Column) -> F.Column:
    """At least one word in twenty is hit."""
    return (F.size(hit) > 0) & (20 * F.size(hit) >= n_words)
