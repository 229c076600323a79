"""Budgeted packing of one change's pieces, group by group: greedy by nature, and one change is small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.corpus import split_text

MAX_CHUNKS = 20
MAX_TOKENS = 8000
#: Characters that fragments without ranges share, and the fewest that one has.
OVERLAP, LEAST_FRAGMENT = 200, 500
#: Files that are held as Python objects at once.
FILE_ROWS = 64


def degrees(edges: DataFrame, group: str = "diff_id") -> DataFrame:
    """(group, path, degree) over both ends of the edges (group, a, b)."""
    ends = edges.select(group, F.col("a").alias("path")).unionAll(edges.select(group, F.col("b").alias("path")))
    return ends.groupBy(group, "path").agg(F.count(F.lit(1)).alias("degree"))


def pack_pieces(pieces: DataFrame, edges: DataFrame, budget: int = MAX_TOKENS, most: int = MAX_CHUNKS, group: str = "diff_id") -> DataFrame:
    """(group, path, part, tokens, chunk): first fit, best connected pieces first; chunk is null for what found no place.

    ``pieces`` (group, ord, path, part, tokens), ``edges`` (group, a, b). A piece goes to the first chunk with room
    that holds a neighbour, else to the first with room, else to a new one while there are fewer than ``most``.
    """
    near = edges.select(group, F.col("a").alias("path"), F.col("b").alias("other")).unionAll(edges.select(group, F.col("b").alias("path"), F.col("a").alias("other"))).groupBy(group, "path").agg(F.array_sort(F.collect_set("other")).alias("near"))
    rows = pieces.select(group, "ord", "path", "part", "tokens").join(near, [group, "path"], "left")
    # each group's pieces follow one another in one partition, so a task holds the chunks of one group at a time
    dealt = rows.repartition(group).sortWithinPartitions(group, F.coalesce(F.size("near"), F.lit(0)).desc(), "ord").select(group, "path", "part", "tokens", "near")
    kind = pieces.schema[group].dataType.simpleString()

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks = None, []  # [used tokens, paths] of the group's chunks
        for batch in parts:
            placed: list[int | None] = []
            for g, path, tokens, near_ in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if now is None or now[0] != g:
                    now, chunks = (g,), []
                linked = set(near_ or ())
                room = [i for i, (used, _) in enumerate(chunks) if used + tokens <= budget]
                at = next((i for i in room if not linked.isdisjoint(chunks[i][1])), room[0] if room else None) if linked else (room[0] if room else None)
                if at is None and len(chunks) < most:
                    at = len(chunks)
                    chunks.append([0, set()])
                if at is not None:
                    chunks[at][0] += tokens
                    chunks[at][1].add(path)
                placed.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(placed, pa.int32())], names=[group, "path", "part", "tokens", "chunk"])

    return dealt.select(group, F.col("path").cast("string"), F.col("part").cast("int"), F.col("tokens").cast("int"), "near").mapInArrow(fill, f"{group} {kind}, path string, part int, tokens int, chunk int")


def fragments(lines: list[str], ranges: list[tuple[int, int]], budget: int) -> list[str]:
    """Fragments of a file that fit ``budget`` tokens, cut between its ``ranges`` (first and last line from 1) where it has some.

    The first fragment begins with the file and the last ends with it. What is too much by itself is cut at
    separators, with an overlap of OVERLAP characters. Blank fragments are left out; nothing else of a file is.
    """
    spans, begin, done = [], 0, 0
    for start, end in sorted(ranges):
        if done and _tokens("\n".join(lines[begin:end])) > budget:
            spans.append((begin, done))
            begin = start - 1
        done = end
    out = []
    for a, z in [*spans, (begin, len(lines))]:
        text = "\n".join(lines[a:z])
        if _tokens(text) <= budget:
            out.append(text)
        else:
            out += split_text(text, max(LEAST_FRAGMENT, 4 * budget - OVERLAP), OVERLAP)
    return [x for x in out if x.strip()] or ["\n".join(lines)]


def _tokens(text: str) -> int:
    """As ``text.token_estimate``."""
    return max(1, len(text) // 4) if text else 0


def file_pieces(files: DataFrame, budget: int = MAX_TOKENS, group: str = "diff_id") -> DataFrame:
    """(group, ord, path, part, parts, content, tokens): each file as one piece, or as fragments where it exceeds the budget.

    ``files`` (group, ord, path, content, ranges array<struct<start: int, end: int>>), such as ``knowledge.indented_ranges``
    gives; only the files over the budget go through Python, a few at a time. ``pack_pieces`` places the result.
    """

    content = F.coalesce("content", F.lit(""))
    rows = files.select(group, "ord", "path", content.alias("content"), "ranges")
    small = rows.filter(X.token_estimate(F.col("content")) <= budget).select(group, "ord", "path", F.lit(0).alias("part"), F.lit(1).alias("parts"), "content")
    none = F.array().cast("array<struct<start: int, end: int>>")
    large = rows.filter(X.token_estimate(F.col("content")) > budget).withColumn("ranges", F.coalesce("ranges", none))

    names = small.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(x, FILE_ROWS) for b in batches for x in range(0, b.num_rows, FILE_ROWS)):
            at, n, of, texts = [], [], [], []
            for i, (text, ranges) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                found = fragments(text.splitlines(), [(r["start"], r["end"]) for r in ranges], budget)
                at += [i] * len(found)
                n += range(len(found))
                of += [len(found)] * len(found)
                texts += found
            own = [part.column(c).take(pa.array(at, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int32()), pa.array(of, pa.int32()), pa.array(texts, pa.string())], names=names)

    kind = T.StructType([*(rows.schema[c] for c in (group, "ord", "path")), *(T.StructField(c, T.IntegerType()) for c in ("part", "parts")), T.StructField("content", T.StringType())])
    return small.unionByName(large.mapInArrow(cut, kind)).withColumn("tokens", X.token_estimate(F.col("content")))


def excerpt_windows(matches: DataFrame, group: list[str], before: int = 3, most: int = 60) -> DataFrame:
    """(group, start, end): windows of ``before`` lines around matching lines (0-based, ``n_lines`` each), merged where they touch.

    A window is left out once the windows before it have ``most`` lines.
    """
    w = Window.partitionBy(*group).orderBy("line")
    rows = matches.select(*group, "line", F.greatest(F.lit(0), F.col("line") - before).alias("start"), F.least("n_lines", F.col("line") + before + 1).alias("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    used = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(*group).orderBy("island").rowsBetween(Window.unboundedPreceding, -1))
    return merged.withColumn("used", F.coalesce(used, F.lit(0))).filter(F.col("used") < most).select(*group, "start", "end")


def files_to_index(files: DataFrame, group: str = "repo", most: int = 2000) -> DataFrame:
    """The files of each repository worth indexing, source before documents and settings, shallow before deep, at most ``most``."""
    from ..functions import text as X

    path = F.col("path")
    doc = F.coalesce(X.language(path), F.lit("markdown")).isin("markdown", "yaml", "json", "toml")
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    order = Window.partitionBy(group).orderBy(doc, depth, "path")
    return files.filter(X.should_index(path, F.col("size"))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)


def truncation_order(changes: DataFrame, group: str = "diff_id") -> DataFrame:
    """``place`` of each file when not all fit: flagged ones, then added, modified or renamed, deleted, as they came."""
    rank = F.when(F.col("status") == "added", 0).when(F.col("status").isin("modified", "renamed"), 1).otherwise(2)
    return changes.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(~F.col("flagged"), rank, "ord")))


def project_summary(files: DataFrame, group: str = "repo", most: int = 4) -> DataFrame:
    """(group, project_type, languages): the first marker file in fixed order; the commonest languages, ties by first seen."""
    from ..functions import constants as K
    from ..functions import text as X

    kind = F.lit(len(K.PROJECT_MARKERS))
    for i, (name, _) in reversed(list(enumerate(K.PROJECT_MARKERS))):
        kind = F.when(X.basename(F.col("path")) == name, i).otherwise(kind)
    labels = F.array(*(F.lit(label) for _, label in K.PROJECT_MARKERS), F.lit(K.UNKNOWN))
    types = files.groupBy(group).agg(labels[F.min(kind)].alias("project_type"))
    counted = files.select(group, "ord", X.language(F.col("path")).alias("language")).filter("language IS NOT NULL").groupBy(group, "language").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "first"))).filter(F.col("k") <= most)
    names = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "language"))), lambda x: x["language"]), ", ").alias("languages"))
    return types.join(names, group, "left").withColumn("languages", F.coalesce("languages", F.lit(K.UNKNOWN)))


def module_breakdown(files: DataFrame, group: str = "repo") -> DataFrame:
    """(group, module, files, category, samples): by top folder; the commonest category, ties by first seen; two first summaries."""
    from ..functions import constants as K

    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(K.ROOT)
    rows = files.withColumn("module", top)
    cats = rows.groupBy(group, "module", "category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = cats.groupBy(group, "module").agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("category"), F.sum("n").alias("files"), F.min("first").alias("first"))
    near = rows.withColumn("k", F.row_number().over(Window.partitionBy(group, "module").orderBy("ord"))).filter("k <= 2").groupBy(group, "module").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "summary"))), lambda x: x["summary"]).alias("samples"))
    return best.join(near, [group, "module"])
