"""Fuzzy, exact and similarity matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.staging import staged

#: So many patterns become literals of one projection.
MOST_PATTERNS = 200
#: So many queries, about, are broadcast at once.
QUERY_BLOCK = 1024
#: Items that are compared with a block of queries at once, and pairs whose distances are added at once.
ITEM_BLOCK, PAIRS = 2048, 1 << 18
#: Far above what rounding changes in a cosine of unit vectors, far below a difference that matters.
SLACK = 1e-9


def normalised(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def deletions(name: Column, most: int = 2) -> Column:
    """All strings that ``name`` becomes by deleting up to ``most`` characters, itself included, without repeats.

    Two strings within an edit distance of ``most`` share one of them, so an equi-join on these finds every such pair.
    """
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    found = level = F.array(name)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.when(F.length(s) > 0, less(s)).otherwise(F.array().cast("array<string>")))))
        found = F.array_union(found, level)
    return found


def fuzzy_pairs(left: DataFrame, right: DataFrame, key: str, most: int = 2, least_length: int = K.MIN_FUZZY_LENGTH) -> DataFrame:
    """(l, r, distance): pairs of names in the same ``key`` at an edit distance of 1 to ``most``, both long enough.

    ``left`` and ``right`` have (key, name), distinct. Equi-join on shared deletions, then the distance is checked; no
    nested loop, and names that share nothing never meet.
    """
    side = lambda df, as_: df.filter(F.length("name") >= least_length).select(F.col(key).alias("k"), F.col("name").alias(as_), F.explode(deletions(F.col("name"), most)).alias("d"))
    near = side(left, "l").join(side(right, "r"), ["k", "d"]).select("k", "l", "r").distinct()
    distance = F.levenshtein("l", "r", most)
    return near.withColumn("distance", distance).filter((F.col("distance") >= 1) & (F.col("distance") <= most)).withColumnRenamed("k", key)


def lookalikes(dependencies: DataFrame, reference: DataFrame) -> DataFrame:
    """(ecosystem, name, looks_like): names that imitate a popular package.

    ``dependencies`` (ecosystem, name), ``reference`` (ecosystem, ord, name). Popular names themselves (also with - for _)
    are exempt. The first reference in list order within two edits wins; else the first that the name extends by one of
    the fixed suffixes.
    """
    eco = F.lower("ecosystem")
    deps = dependencies.select(eco.alias("eco"), "ecosystem", "name").distinct().withColumn("low", F.lower("name")).withColumn("norm", normalised(F.col("name")))
    refs = reference.select(eco.alias("eco"), "ord", F.col("name").alias("ref")).withColumn("rnorm", normalised(F.col("ref")))
    popular = refs.select("eco", F.col("ref").alias("p")).distinct()
    deps = deps.join(popular, (deps.eco == popular.eco) & (deps.low == popular.p), "left_anti")
    deps = deps.join(popular, (deps.eco == popular.eco) & (deps.norm == popular.p), "left_anti")
    pairs = fuzzy_pairs(deps.select("eco", F.col("norm").alias("name")).distinct(), refs.select("eco", F.col("rnorm").alias("name")).distinct(), "eco")
    typo = pairs.join(refs, (pairs.eco == refs.eco) & (pairs.r == refs.rnorm)).groupBy(pairs.eco, F.col("l").alias("norm")).agg(F.min_by("ref", "ord").alias("typo_of"))
    longer = refs.withColumn("suffix", F.explode(F.array(*(F.lit(s) for s in K.COMBOSQUAT_SUFFIXES)))).select("eco", "ord", "ref", F.concat("rnorm", "suffix").alias("norm"))
    combo = longer.groupBy("eco", "norm").agg(F.min_by("ref", "ord").alias("combo_of"))
    found = deps.join(typo, ["eco", "norm"], "left").join(combo, ["eco", "norm"], "left")
    return found.select("ecosystem", "name", F.coalesce("typo_of", "combo_of").alias("looks_like")).filter("looks_like IS NOT NULL")


def shared_literal_edges(literals: DataFrame, group: str, node: str, literal: str = "literal") -> DataFrame:
    """(group, a, b), a < b: nodes of one group that share a literal, each pair once, by a join on group and literal."""
    x = literals.select(group, F.col(node).alias("a"), F.col(literal).alias("lit")).distinct()
    y = x.select(F.col(group).alias("g2"), F.col("a").alias("b"), F.col("lit").alias("lit2"))
    return x.join(y, (x[group] == y.g2) & (x.lit == y.lit2) & (x.a < y.b)).select(group, "a", "b").distinct()


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths): the vectors of a column as rows; one that is null, has a null or another width than the rest is NaN."""
    lists = column.to_pylist() if column.null_count or column.flatten().null_count else None
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if lists is None and (sizes == width).all():
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width)
    else:
        rows = lists if lists is not None else column.to_pylist()
        m = np.array([r if r is not None and len(r) == width and None not in r else [np.nan] * width for r in rows], np.float64).reshape(len(rows), width)
    return m, np.sqrt(_sums(m, m))


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scalar products of rows with rows, added from the first column to the last in doubles, as SQL does."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        total += a[:, c] * b[:, c]
    return total


def top_k(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, id, rank, distance, ...): the k nearest items of each query by cosine distance, ties by id; exact.

    Queries meet all items in blocks of about ``block``, dealt by id, one after the other: what is broadcast at once has a
    bound, however many queries there are. In a task one matrix product compares a batch of items with the block. Its
    rounding may differ from SQL's, so it only leaves out what lies beyond the k-th by more than ``SLACK``; the others' distances
    are added in order. Each task keeps the best k of each query, and only these are shuffled. A vector without a
    direction (null, with a null, zero) has no distance and comes last.
    """
    keep = keep or []
    q = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("qv"))
    i = items.select(F.col(id_col).alias("id"), F.col(vec_col).alias("iv"), *keep)
    kind = T.StructType([T.StructField("query", q.schema["query"].dataType), i.schema["id"], *(i.schema[c] for c in keep), T.StructField("distance", T.DoubleType())])
    order = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "id")

    def ranked(part: pa.Table) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(part)
        return i.mapInArrow(lambda batches: _nearest(batches, shared.value, k, kind.names, ITEM_BLOCK), kind).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    blocks = max(1, -(-queries.count() // block))
    own = F.pmod(F.xxhash64("query"), F.lit(blocks))
    if blocks == 1:
        return ranked(q.toArrow())
    return reduce(DataFrame.unionByName, [staged(ranked(q.filter(own == b).toArrow())) for b in range(blocks)])


def _nearest(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, names: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Of a task's items (id, iv, ...) the k nearest to each of the queries ``asked`` (query, qv), as (query, id, ..., distance)."""
    qm, qn = _rows_of(asked["qv"].combine_chunks())
    with np.errstate(divide="ignore", invalid="ignore"):
        qu = np.nan_to_num(qm / qn[:, None])
    blank = ~(qn > 0)
    best: pa.Table | None = None  # rows: place of the query, item's columns, distance, all sorted
    worst = np.full(asked.num_rows, np.inf)
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            m, norm = _rows_of(part.column(1))
            if not m.shape[1] == qm.shape[1]:
                m, norm = np.full((len(m), qm.shape[1]), np.nan), np.full(len(m), np.nan)
            with np.errstate(divide="ignore", invalid="ignore"):
                near = 1 - qu @ np.nan_to_num(m / norm[:, None]).T
            near[:, ~(norm > 0)] = np.inf
            near[blank] = np.inf
            limit = worst if len(norm) <= k else np.minimum(worst, np.partition(near, k - 1, axis=1)[:, k - 1])
            who, which = np.nonzero(near <= (limit + SLACK)[:, None])
            if not len(who):
                continue
            exact = np.concatenate([_exact(qm, qn, m, norm, who[x : x + PAIRS], which[x : x + PAIRS]) for x in range(0, len(who), PAIRS)])
            rows = pa.table([pa.array(who), *(part.column(c).take(pa.array(which)) for c in range(part.num_columns) if c != 1), pa.array(exact)], names=names)
            best = _first(rows if best is None else pa.concat_tables([best, rows]), k)
            places, far = best["query"].to_numpy(), best["distance"].to_numpy()
            full = np.bincount(places, minlength=len(worst)) >= k
            last = np.full(len(worst), -np.inf)
            np.maximum.at(last, places, far)
            worst = np.where(full, last, np.inf)
    if best is not None:
        far = best["distance"].to_numpy()
        columns = [asked["query"].take(best["query"]), *best.columns[1:-1], pa.array(far, mask=np.isinf(far))]
        yield from pa.table(columns, names=names).combine_chunks().to_batches()


def _exact(qm: np.ndarray, qn: np.ndarray, m: np.ndarray, norm: np.ndarray, who: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Distances of pairs; infinite where one has no direction."""
    with np.errstate(divide="ignore", invalid="ignore"):
        distance = 1 - _sums(qm[who], m[which]) / (qn[who] * norm[which])
    return np.where(np.isfinite(distance), distance, np.inf)


def _first(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of each query by distance and id."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(rows.column_names[0], "ascending"), ("distance", "ascending"), (rows.column_names[1], "ascending")]))
    places = rows[0].to_numpy()
    begin = np.searchsorted(places, places, side="left")
    return rows.filter(pa.array(np.arange(len(places)) - begin < k))


def diversified_top_k(ranked: DataFrame, k: int, case_col: str) -> DataFrame:
    """The best item of each case within the top 3k of each query, then the best k of these. ``ranked``: from ``top_k`` with 3k."""
    best = Window.partitionBy("query", case_col).orderBy("rank")
    first = ranked.filter(F.col("rank") <= 3 * k).withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("place") <= k)


def with_reserved(feedback: DataFrame, corpus: DataFrame, slots: int, k: int) -> DataFrame:
    """Up to ``slots`` feedback results first, the rest from the corpus; ``place`` numbers them from 1."""
    both = feedback.filter(F.col("rank") <= slots).withColumn("source", F.lit(0)).unionByName(corpus.withColumn("source", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("source", "rank"))).filter(F.col("place") <= k)


def rule_hits(texts: DataFrame, rules: DataFrame, id_cols: list[str], text_col: str, most: int = MOST_PATTERNS) -> DataFrame:
    """(ids, rule_id, score, nature): texts that a rule's pattern matches. ``rules``: rule_id, pattern, score, nature and perhaps language.

    Rules are configuration: they come to the driver and become literals of one projection, compiled once each, so a text is
    read once and meets no join. Over ``most`` rules go in parts, each with a pass of its own. A rule with a language only
    meets texts of that ``language``, if texts have this column; null texts match nothing.
    """
    parts: list[list[Column]] = [[]]
    kind = "struct<rule_id: string, score: int, nature: string>"
    for r in rules.toLocalIterator():
        if len(parts[-1]) >= most:
            parts.append([])
        fits = F.rlike(F.col(text_col), F.lit(r.pattern))
        own = getattr(r, "language", None)
        if own is not None and "language" in texts.columns:
            fits = (F.col("language") == own) & fits
        parts[-1].append(F.when(fits, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.score).cast("int").alias("score"), F.lit(r.nature).cast("string").alias("nature"))))
    found = lambda part: texts.select(*id_cols, F.explode(F.array_compact(F.array(*part) if part else F.array().cast(f"array<{kind}>"))).alias("h")).select(*id_cols, "h.*")
    return reduce(DataFrame.unionByName, [found(p) for p in parts])


def literal_classes(literals: DataFrame, group: str, node: str, literal: str = "literal") -> DataFrame:
    """(group, literal, node, size, first): the nodes of each literal that two or more nodes of a group share, without all their pairs.

    Two nodes are linked if they are in one class; ``first`` names the class's smallest node. A literal of many nodes has a
    row for each of them, and its size is counted before rows meet, so no task holds a class.
    """
    x = literals.select(group, F.col(literal).alias("literal"), F.col(node).alias("node")).distinct()
    sizes = x.groupBy(group, "literal").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter("size > 1")
    return x.join(sizes, [group, "literal"]).select(group, "literal", "node", "size", "first")


def import_edges(files: DataFrame, group: str = "diff_id") -> DataFrame:
    """(group, a, b), a < b: one file's import specifiers contain the other's name without extension. No self-loops.

    ``files`` (group, path, imports array). Stems meet specifiers through the specifier's substrings of the stems'
    lengths, an equi-join within the group.
    """
    from ..functions.text import stem

    stems = files.select(group, F.col("path").alias("target"), stem(F.col("path")).alias("stem")).filter("stem != ''")
    lengths = stems.groupBy(group).agg(F.array_sort(F.collect_set(F.length("stem"))).alias("sizes"))
    specs = files.select(group, F.col("path").alias("source"), F.explode("imports").alias("spec")).distinct().join(lengths, group)
    cut = specs.select(group, "source", "spec", F.explode("sizes").alias("n")).filter(F.length("spec") >= F.col("n"))
    cut = cut.select(group, "source", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("spec") - F.col("n") + 1), lambda i: F.substr("spec", i, F.col("n"))))).alias("stem"))
    return cut.join(stems, [group, "stem"]).filter("source != target").select(group, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
