"""A stored vector index for nearest neighbours by cosine: cells around centres, searched cell by cell and ranked exactly.

Centres come from a bounded sample of the vectors; every vector then lies in the cell of its nearest centre, and the index
is a Parquet table partitioned by cell. A search reads the cells nearest to each query and ranks what it finds by exact
distances, so only the choice of cells is approximate: with all cells it is the exact search. ``matching.top_k`` stays
the exact search without an index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import staged
from ..sources.table_set import TableSet
from .matching import QUERY_BLOCK

#: Vectors that centres are computed from, at most; all vectors are indexed.
SAMPLE_ROWS = 20_000
#: Cells grow with the root of the table, so that a cell grows with it too; the sample bounds their number.
MOST_CELLS = SAMPLE_ROWS // 20
ROUNDS = 8
#: Rows of one cell that one task writes, about: a cell that holds much of the table is written by several.
_SALT_ROWS = 200_000


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column without nulls as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``cells`` groups of the sample's directions; the first ones are spread over the sample in its order."""
    units = _units(sample)
    if not len(units):
        return units
    centres = units[np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        filled = np.bincount(nearest, minlength=len(centres)) > 0
        centres[filled] = _units(sums[filled])
    return centres


def usable(vec_col: str):
    """Vectors that have a direction: not null, without null, not all zero."""
    v = F.col(vec_col)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def rebuild(spark: SparkSession, items: DataFrame, base: str, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> TableSet:
    """Indexes all of ``items`` as a new version of the index under ``base``; searches go on with the version they opened.

    Vectors without a direction (null, with nulls, zero) have no distance to anything and aren't indexed. All vectors have one
    length. Rows that repeat an id are indexed each.
    """
    rows = items.filter(usable(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *(keep or []))
    n = rows.count()
    cells = cells or int(max(1, min(MOST_CELLS, round(n**0.5))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").toArrow()
    centres = centres_of(_matrix(sample["vec"]), cells)
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.argmax(_units(_matrix(part.column(1))) @ shared.value.T, axis=1) if part.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32))], names=schema.names)

    placed = staged(rows.mapInArrow(place, schema))
    # a cell is written by as many tasks as its share of the rows asks for
    share = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _SALT_ROWS).alias("salts"))
    dealt = placed.join(F.broadcast(share), "cell").withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("salts"))).repartition("cell", "_salt").drop("salts", "_salt")
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return TableSet(spark, base).commit({"items": dealt, "centres": middle.join(counts, "cell", "left").fillna(0, ["n"])})


def search(index: TableSet, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, id, rank, distance): the k nearest indexed vectors of each query within its ``probes`` nearest cells, ties by id.

    Queries go in blocks of about ``block``, whose vectors are broadcast; each task ranks its rows of the cells that the
    block probes and keeps the best k of each query, so that little is shuffled. Queries without a direction have no rows.
    """
    spark = queries.sparkSession
    kept = index.read("centres").orderBy("cell").toArrow()
    centres = np.array(kept["centre"].to_pylist(), np.float64)
    q = queries.filter(usable(vec_col)).select(F.col(id_col).cast("long").alias("query"), F.col(vec_col).alias("qv"))
    items = index.read("items").select(F.col("id").cast("long").alias("id"), "vec", "cell")
    blocks = max(1, -(-q.count() // block))
    own = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = []
    for b in range(blocks):
        part = q.filter(own == b).toArrow()  # at most about ``block`` rows
        names, vectors = part["query"].to_numpy(), _matrix(part["qv"])
        if not len(names) or not len(centres):
            continue
        near = np.argsort(-(_units(vectors) @ centres.T), axis=1, kind="stable")[:, :probes]
        asked: dict[int, list[int]] = {}
        for i, row in enumerate(near.tolist()):
            for c in row:
                asked.setdefault(c, []).append(i)
        shared = spark.sparkContext.broadcast((names, vectors, np.sqrt((vectors * vectors).sum(axis=1)), asked))

        def rank(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors, sizes, asked = shared.value
            best: dict[int, list[tuple[float, int]]] = {}
            for part in parts:
                cell, ids, m = part.column(2).to_numpy(), part.column(0).to_numpy(), _matrix(part.column(1))
                norm = np.sqrt((m * m).sum(axis=1))
                for c in np.unique(cell).tolist():
                    at, who = np.flatnonzero(cell == c), asked.get(c, [])
                    if not who:
                        continue
                    distance = 1 - (m[at] @ vectors[who].T) / (norm[at][:, None] * sizes[who][None, :])
                    for j, i in enumerate(who):
                        few = np.lexsort((ids[at], distance[:, j]))[:k]
                        best[i] = sorted([*best.get(i, []), *zip(distance[few, j].tolist(), ids[at][few].tolist(), strict=True)])[:k]
            rows = [(names[i], x, d) for i, l in best.items() for d, x in l]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "id", "distance"])

        found.append(items.filter(F.col("cell").isin([int(c) for c in asked])).mapInArrow(rank, "query long, id long, distance double"))
    if not found:
        return spark.createDataFrame([], "query long, id long, rank int, distance double")
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).filter(F.col("rank") <= k).select("query", "id", "rank", "distance")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(n_queries, recall): the share of the exact k nearest (query, id, rank) that ``found`` has."""
    want = exact.filter(F.col("rank") <= k).select("query", "id")
    hit = found.filter(F.col("rank") <= k).select("query", "id", F.lit(1).alias("hit"))
    return want.join(hit, ["query", "id"], "left").agg(F.countDistinct("query").alias("n_queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
