"""Packing into length buckets that waste the least padding, and batches under a token budget.

The histogram of lengths up to the token budget has one bin for each length. Dynamic programming over it chooses up to
``buckets`` upper bounds; every such document is padded to the bound of its bucket. Longer documents stand alone in a
batch anyway: they form one more bucket, have no part in the choice of bounds and are not padded. Inside a bucket
documents stand by length, and as many as the budget holds at that bound form a batch. Positions come from counts of
small chunks, so that no bucket and no length, however common, is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import partitions_for, staged

#: The histogram that the driver gets has so many bins for lengths from 1 to the budget; only where the budget is larger do lengths share bins.
BINS = 16_384
BUCKETS = 12
TOKEN_BUDGET = 16_384
#: Documents of one length are numbered in chunks of about so many.
CHUNK_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding: ``counts`` documents of ``totals`` tokens are at most ``lengths`` long.

    Padding of one bucket over a stretch is (its last length) * (documents) - (tokens). These costs are Monge, so the
    best cut never moves back and each row of the table is filled by halving. Of equal sums fewer buckets win.
    """
    d = len(lengths)
    if d == 0:
        return []
    c, t = np.r_[0, np.cumsum(counts)].astype(np.float64), np.r_[0, np.cumsum(totals)].astype(np.float64)
    best, cuts, sums = np.r_[0.0, np.full(d, np.inf)], [], []

    def fill(lo: int, hi: int, first: int, last: int, old: np.ndarray, new: np.ndarray, at: np.ndarray) -> None:
        todo = [(lo, hi, first, last)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            cost = old[i] + lengths[j - 1] * (c[j] - c[i]) - (t[j] - t[i])
            k = int(np.argmin(cost))
            new[j], at[j] = cost[k], i[k]
            todo += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]

    for k in range(min(buckets, d)):
        new, at = np.full(d + 1, np.inf), np.zeros(d + 1, np.int64)
        fill(k + 1, d, k, d - 1, best, new, at)
        best = new
        cuts.append(at)
        sums.append(new[d])
    k = int(np.argmin(sums))
    out, j = [], d
    while k >= 0:
        out.append(int(lengths[j - 1]))
        j, k = int(cuts[k][j]), k - 1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, bins: int = BINS) -> DataFrame:
    """One row per document: id, n_tokens, bucket, padded (the bucket's bound, or a longer document's own length), batch (from 0 in each bucket), slot.

    ``tokens`` is the length (words of the text unless given; null or less than 0 counts as 0). A batch has
    ``budget`` // padded documents, at least one; only the last batch of a bucket may have fewer. Documents longer than
    the budget stand alone, uncut, in a bucket after those of all others and by id. Documents without tokens are packed
    like others. Inside a bucket documents stand by length bin, then by chunk (a hash of id and text) and
    id, so that neither one length nor ids of any kind make a task large. Rows that repeat an id stand by their texts,
    and equal rows are interchangeable. Ids may be of any type; rows with a null id stand in the order they are read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")) if text_col in docs.columns else F.lit("")
    length = F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)) if tokens is not None else word_count(F.col(text_col))
    place = F.xxhash64(F.col(id_col), text, F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    rows = staged(docs.select(F.col(id_col).alias("id"), length.alias("n_tokens"), place.alias("place")), "lengths")
    width, over = max(1, -(-budget // bins)), budget + 1  # by the parameters alone, so that no document changes another's bin
    ordinary = F.least(F.ceil(F.col("n_tokens") / width).cast("long") * width, F.lit(budget))
    rows = rows.withColumn("bin", F.when(F.col("n_tokens") > budget, over).otherwise(ordinary).cast("long")).withColumn("chunk", F.pmod("place", F.lit(partitions_for(rows.count(), CHUNK_ROWS))))
    chunks = staged(rows.groupBy("bin", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")), "chunks")
    hist = sorted((r.bin, r.n, r.tokens) for r in chunks.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect())
    short = [h for h in hist if h[0] < over]
    bounds = boundaries(*(np.array([h[i] for h in short], np.int64) for i in range(3)), buckets)
    plan, b, offset = [(over, len(bounds), None, 0)], 0, 0
    for length_, n, _ in short:
        while length_ > bounds[b]:
            b, offset = b + 1, 0
        plan.append((length_, b, bounds[b], offset))
        offset += n
    spark = docs.sparkSession
    bins_ = F.broadcast(spark.createDataFrame(plan, "bin long, bucket int, bound long, bin_offset long"))  # at most ``bins`` + 2 rows
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = chunks.select("bin", "chunk", F.coalesce(before, F.lit(0)).alias("chunk_offset")).join(bins_, "bin")
    inside = F.row_number().over(Window.partitionBy("bin", "chunk").orderBy("id", "place")) - 1
    rank = F.col("bin_offset") + F.col("chunk_offset") + F.col("inside")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded", F.lit(1)))).cast("long")
    placed = rows.join(offsets.hint("merge"), ["bin", "chunk"]).withColumns({"inside": inside, "padded": F.coalesce("bound", "n_tokens")}).withColumns({"rank": rank, "room": room})
    return placed.select("id", "n_tokens", "bucket", "padded", F.floor(F.col("rank") / F.col("room")).alias("batch"), (F.col("rank") % F.col("room")).alias("slot"))
