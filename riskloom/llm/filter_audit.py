"""How filters of documents interact: which documents each removes, in every order of application.

Every document gets a mask with one bit for each filter that it fails, whatever was removed before. Audits of all orders
then need the numbers of documents by mask alone, as a document leaves at the first filter of an order that its mask has.

One filter marks documents whose text a smaller id has already. It needs no shuffle of all texts: each task counts the
hashes of its texts into a counting Bloom sketch (cells that stop at 2), the sketches are merged, and a text with a cell
that counts 1 is certain to be the only one. Only the other texts, possible repeats, are shuffled, and grouped as
whole texts, so collisions of hashes cost time but never change a mask.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import combined, staged
from .words import mix

U = np.uint64
#: Cells for each text and cells that a text counts in: about 3 of 100 single texts pass as possible repeats.
CELLS, HASHES = 8, 3
#: The sketch grows with the number of texts up to so many bytes (four cells each), which is what is broadcast. Beyond
#: (here: 33 million texts) it stays as it is, so it clears fewer texts and more are shuffled; masks are the same.
SKETCH_BYTES = 64 << 20
#: Cells of a block, in which sketches are merged.
_BLOCK = 1 << 16
_CHUNK = 1 << 18


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """(HASHES, n): the cells of each hash, all different. ``cells`` is a power of two."""
    h = hashes.view(U)
    with np.errstate(over="ignore"):
        first, step = mix(h), mix(h ^ U(0x5851F42D4C957F2D)) | U(1)
        return np.stack([(first + U(i) * step) & U(cells - 1) for i in range(HASHES)])


def counting_sketch(hashes: DataFrame, cells: int) -> bytes:
    """Cells of all rows of ``hashes`` (h long), four in a byte, each 0, 1 or 2 (2 or more)."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def counted() -> pa.RecordBatch:
            cell, n = np.unique(cells_of(np.concatenate(held), cells), return_counts=True)
            block, at = (cell // U(_BLOCK)).astype(np.int64), (cell % U(_BLOCK)).astype(np.uint32)
            names, start = np.unique(block, return_index=True)
            pieces = [(b, at[lo:hi][n[lo:hi] == 1].tobytes(), at[lo:hi][n[lo:hi] > 1].tobytes()) for b, lo, hi in zip(names.tolist(), start, [*start[1:], len(block)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "once", "more"])

        for part in parts:
            held.append(combined(part, "h").to_numpy())
            rows += part.num_rows
            if rows >= _CHUNK:
                yield counted()
                held, rows = [], 0
        if rows:
            yield counted()

    def merge(part: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.uint8)
        for once, more in zip(part["once"].to_pylist(), part["more"].to_pylist(), strict=True):
            total[np.frombuffer(once, np.uint32)] += 1  # no cell stands twice in a piece
            total[np.frombuffer(more, np.uint32)] = 2
            np.minimum(total, 2, out=total)
        four = total.reshape(-1, 4)
        return pa.table({"block": part["block"][:1], "packed": pa.array([(four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()], pa.binary())})

    size = min(_BLOCK, cells) // 4
    out = bytearray(max(cells, _BLOCK) // 4)
    for r in hashes.mapInArrow(count, "block long, once binary, more binary").groupBy("block").applyInArrow(merge, "block long, packed binary").collect():
        out[r.block * size : (r.block + 1) * size] = r.packed[:size]
    return bytes(out[: cells // 4])


def possible_repeat(hashes: np.ndarray, sketch: np.ndarray, cells: int) -> np.ndarray:
    """False for hashes that are certain to have been counted once."""
    found = np.ones(len(hashes), bool)
    for c in cells_of(hashes, cells):
        found &= (sketch[c >> U(2)] >> ((c & U(3)) << U(1)).astype(np.uint8)) & 3 == 2
    return found


def masks(docs: DataFrame, filters: Mapping[str, Callable[[Column], Column]], repeats: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """One row per document: id, part, mask. Bit i is set if it fails the i-th filter; the last bit is that of ``repeats``.

    ``filters`` maps a name to a function of the text column that says whether a document fails; it must not be null.
    A document fails ``repeats`` if a smaller id has an identical text. Null texts count as empty, null parts are the
    empty string. Rows that repeat an id with the same text are judged alike; a null id is never larger than another, so
    such rows don't fail ``repeats``. An empty table gives no rows. Other columns are not read, so their names do no harm.
    """
    if repeats in filters or len(filters) > 30:
        raise ValueError("filters need different names, 31 at most")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = F.lit(0)
    for i, fails in enumerate(filters.values()):
        bits = bits + F.when(fails(F.col("text")), F.lit(1 << i)).otherwise(F.lit(0))
    facts = staged(rows.select("id", "part", bits.alias("mask"), F.xxhash64("text").alias("h")), "facts")
    cells = 1 << max(8, (CELLS * max(facts.count(), 1) - 1).bit_length())
    cells = min(cells, 1 << ((4 * sketch_bytes).bit_length() - 1))
    shared = spark.sparkContext.broadcast(counting_sketch(facts.select("h"), cells))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(possible_repeat(h.to_numpy(), np.frombuffer(shared.value, np.uint8), cells))

    again = rows.select("id", "text", F.xxhash64("text").alias("h")).filter(maybe("h"))
    firsts = again.groupBy("h", "text").agg(F.min("id").alias("id")).select("id", "h", F.lit(True).alias("first")).filter("id IS NOT NULL").distinct()
    judged = facts.withColumn("maybe", maybe("h"))
    repeated = judged.filter("maybe").join(firsts.hint("merge"), ["id", "h"], "left").withColumn("fails", F.col("id").isNotNull() & F.col("first").isNull())
    both = judged.filter("NOT maybe").select("id", "part", "mask", F.lit(False).alias("fails")).unionByName(repeated.select("id", "part", "mask", "fails"))
    return both.select("id", "part", (F.col("mask") + F.when(F.col("fails"), F.lit(1 << len(filters))).otherwise(F.lit(0))).alias("mask"))


def histogram(masked: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, those labelled ``quality`` = 1, those labelled ``toxic`` = 1.

    Rows of ``labels`` that repeat an id count once; a document is good (toxic) if any of them says so.
    """
    if labels is None:
        marked = masked.withColumns({"good": F.lit(0), "bad": F.lit(0)})
    else:
        marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
        marked = masked.join(marks.hint("merge"), "id", "left")
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"), F.sum(F.coalesce("bad", F.lit(0))).cast("long").alias("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counts`` is a ``histogram``; ``letters`` names its bits, lowest first (seven filters at most, as all orders are listed).
    ``shapley`` is what the step's filter removes, summed over all orders: a document that fails k filters is removed by
    each of them in one of k orders. Counts add, so a part's rows are sums over its masks.
    """
    if len(set(letters)) != len(letters) or not 0 < len(letters) < 8:
        raise ValueError("one letter for each of 1 to 7 filters")
    bit = {c: 1 << i for i, c in enumerate(letters)}
    steps = [f"{''.join(o)}|{k + 1}|{sum(bit[c] for c in o[:k])}|{bit[c]}" for o in itertools.permutations(letters) for k, c in enumerate(o)]
    orders = 1
    for k in range(2, len(letters) + 1):
        orders *= k
    said = F.split("said", r"\|")
    each = counts.select("*", F.explode(F.split(F.lit(",".join(steps)), ",")).alias("said")).select(
        "part", "mask", "n", "good", "toxic", said[0].alias("filter_order"), said[1].cast("int").alias("step"), said[2].cast("int").alias("before"), said[3].cast("int").alias("own")
    )
    gone, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("own")) != 0
    add = lambda holds, n="n": F.sum(F.when(holds, F.col(n)).otherwise(F.lit(0)))
    share = F.when(fails, F.col("n") * F.expr(f"{orders} div greatest(bit_count(mask), 1)")).otherwise(F.lit(0))
    return each.groupBy("part", "filter_order", "step").agg(
        add(~gone & ~fails).alias("kept"),
        add(~gone & fails).alias("removed"),
        add(gone & fails).alias("redundant"),
        add(F.col("mask") == F.col("own")).alias("unique_fails"),
        add(~gone & fails, "good").alias("good_lost"),
        add(~gone & fails, "toxic").alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame | None, filters: Mapping[str, Callable[[Column], Column]], repeats: str, **columns: str) -> DataFrame:
    """``interactions`` of the documents' ``masks``; filters are named by one letter each, ``repeats`` is the last."""
    return interactions(histogram(masks(docs, filters, repeats, **columns), labels, columns.get("id_col", "doc_id")), "".join([*filters, repeats]))
