"""Reference lists, case corpora, examples and tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def read_reference_list(spark: SparkSession, path: str, ecosystem: str) -> DataFrame:
    """(ecosystem, ord, name): one popular package a line, blank lines dropped, in the file's order."""
    text = spark.read.text(path, wholetext=True)
    named = text.select(F.posexplode(F.transform(X.lines(F.col("value")), lambda x: X.strip(x))).alias("ord", "name"))
    return named.filter("name != ''").select(F.lit(ecosystem).alias("ecosystem"), "ord", "name")


def updated_reference_list(current: DataFrame, fetched: DataFrame) -> DataFrame:
    """The union of both lists by name, numbered in the order of the lower-cased names within each ecosystem."""
    from pyspark.sql import Window

    names = current.select("ecosystem", "name").union(fetched.select("ecosystem", "name")).distinct()
    return names.withColumn("ord", F.row_number().over(Window.partitionBy("ecosystem").orderBy(F.lower("name"), "name")) - 1)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, title, description, kind, body): Markdown cases, one per file; README files are left out.

    Title: the first ``#`` heading. Description: the first paragraph after the first ``##`` heading. Kind: by prefix
    of the file's name, ``feedback`` or ``advisory``, else ``case``.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    raw = raw.withColumn("case_id", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)).filter(F.lower("case_id") != "readme")
    return raw.select("case_id", *case_fields(F.col("body"), F.col("case_id")), "body")


def case_fields(body, case_id):
    title = F.nullif(X.strip(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    description = F.nullif(X.strip(F.regexp_extract(body, r"(?ms)^##\s+[^\n]*\n+(.+?)(?:\n\s*\n|\z)", 1)), F.lit(""))
    kind = F.when(F.startswith(case_id, F.lit("feedback")), "feedback").when(F.startswith(F.lower(case_id), F.lit("ghsa")) | F.startswith(F.lower(case_id), F.lit("mal-")), "advisory").otherwise("case")
    return F.coalesce(title, case_id).alias("title"), description.alias("description"), kind.alias("kind")


#: A text is cut at the first of these that it has; parts that are still too long at the next; fixed values.
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 1000, overlap: int = 100, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters without white space at their ends, cut at separators; a chunk repeats up to ``overlap`` characters of the last.

    A separator stays at the head of the part that it begins. Parts shorter than ``size`` are joined while they fit.
    """
    at = next(i for i, s in enumerate(separators) if s in text)
    sep, finer = separators[at], separators[at + 1 :]
    head, *tail = text.split(sep) if sep else ["", *text]
    parts, out, first = [p for p in (head, *(sep + t for t in tail)) if p], [], 0
    for i in range(len(parts) + 1):
        if i == len(parts) or len(parts[i]) >= size:
            out += _joined(parts[first:i], size, overlap)
            first = i + 1
            if i < len(parts):
                out += split_text(parts[i], size, overlap, finer) if finer else [parts[i]]
    return out


def _joined(parts: list[str], size: int, overlap: int) -> list[str]:
    """Windows over the parts: each is as long as ``size`` allows and begins with parts of at most ``overlap`` characters of the one before."""
    ends = [0]
    for p in parts:
        ends.append(ends[-1] + len(p))
    out, a = [], 0
    for z in range(len(parts)):
        if a < z and ends[z + 1] - ends[a] > size:
            out.append("".join(parts[a:z]).strip())
            while a < z and (ends[z] - ends[a] > overlap or ends[z + 1] - ends[a] > size):
                a += 1
    out.append("".join(parts[a:]).strip())
    return [x for x in out if x]


def split_column(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """array<string> of the chunks of ``split_text``; a null text has none."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return split(text)


def split_chunks(cases: DataFrame, id_col: str = "case_id", text_col: str = "body", size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, n, chunk): the chunks of each text at separators, numbered from 0."""
    return cases.select(F.col(id_col).alias("id"), F.posexplode(split_column(F.col(text_col), size, overlap)).alias("n", "chunk"))


def chunks(cases: DataFrame, id_col: str = "case_id", text_col: str = "body", size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, n, chunk): fixed windows, whatever the text, of at most ``size`` characters that overlap by ``overlap``; a blank text has none."""
    step = size - overlap
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    starts = F.when(X.strip(text) != "", F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return cases.select(F.col(id_col).alias("id"), text.alias("t"), F.explode(starts).alias("n")).select("id", "n", F.substr("t", F.col("n") * step + 1, F.lit(size)).alias("chunk"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("diff_summary string, expected_output string").json(path, multiLine=True)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of a tree's UTF-8 files; others are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).filter("content IS NOT NULL")


def rules_from_catalog(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """(rule_id, pattern, score, nature, language): text rules as a small table for broadcasting. ``score``: 60 unless an integer is given."""
    rows = [(r["id"], r["pattern"], r["risk_score"] if isinstance(r.get("risk_score"), int) else 60, r.get("finding_type"), r.get("language")) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, pattern string, score int, nature string, language string")
