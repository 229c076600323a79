"""Cases, advisories, caches and source structure."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X

# --- cases and advisories ---------------------------------------------------------------------------------------


def clean_description(text: Column) -> Column:
    """An advisory's text without source headings, credits, rules and heading marks; at most one blank line in a row."""
    text = F.regexp_replace(text, r"(?m)^#{1,6}\s*Source:.*$", "")
    kept = F.filter(X.lines(text), lambda x: (X.strip(x) != "---") & ~F.startswith(F.lower(X.strip(x)), F.lit("credit:")))
    plain = F.regexp_replace(F.array_join(kept, "\n"), r"(?m)^#{1,6}\s+", "")
    return X.strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))


def safe_id(text: Column, prefix: str = "advisory-") -> Column:
    """A case id of letters, digits, - and _ only."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(X.strip(text)), r"[^a-z0-9_-]+", "-"))


def advisory_cases(advisories: DataFrame, most: int = 4000) -> DataFrame:
    """(case_id, body) of advisories (ghsa_id, type, summary, description, packages array<struct<name, ecosystem, affected, patched>>).

    Without an id or a summary there is no case; of equal ids the first by id text wins.
    """
    text = clean_description(F.coalesce("description", F.lit("")))
    text = F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit(" […]"))).otherwise(text)
    body = F.coalesce(F.nullif(text, F.lit("")), F.col("summary"))
    line = F.transform(F.filter("packages", lambda p: F.coalesce(p["name"], F.lit("")) != ""), lambda p: F.concat(F.lit("- "), p["name"], F.lit(" ("), F.coalesce(p["ecosystem"], F.lit("?")), F.lit("): "), F.coalesce(p["affected"], F.lit("all versions")), F.coalesce(F.concat(F.lit("; fixed in "), p["patched"]), F.lit(""))))
    names = F.array_join(F.slice(F.array_distinct(F.transform("packages", lambda p: p["name"])), 1, 5), ", ")
    parts = F.concat_ws("\n\n", F.concat(F.lit("# "), "summary", F.lit(" ("), "ghsa_id", F.lit(")")), F.lit("## Summary"), body, F.when(F.size(line) > 0, F.concat(F.lit("## Packages\n\n"), F.array_join(line, "\n"))), F.concat(F.lit("## Watch for\n\n"), names))
    rows = advisories.filter((F.coalesce("ghsa_id", F.lit("")) != "") & (X.strip(F.coalesce("summary", F.lit(""))) != "")).select(safe_id(F.col("ghsa_id")).alias("case_id"), "ghsa_id", parts.alias("body"))
    return rows.groupBy("case_id").agg(F.min_by("body", "ghsa_id").alias("body"))


def changed_cases(corpus: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases to write: new ids and those whose text differs; identical ones are left alone."""
    return cases.join(corpus.select("case_id", F.sha2("body", 256).alias("h")), "case_id", "left").filter(F.col("h").isNull() | (F.col("h") != F.sha2("body", 256))).drop("h")


def upsert_case(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces all chunks of the new cases' ids."""
    return chunks.join(new.select("case_id").distinct(), "case_id", "left_anti").unionByName(new)


def cache_plan(wanted: DataFrame, cache: DataFrame, now: str, most: int, hours: int = 24) -> DataFrame:
    """(ecosystem, name, version, source): ``cache``, ``fetch`` for the first ``most`` uncached ones by ``ord``, else ``limit``.

    Positions among the uncached come from one running number per request, ``request``.
    """
    fresh = cache.filter(F.col("fetched_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")).select("ecosystem", "name", "version", F.lit(True).alias("hit")).distinct()
    rows = wanted.join(fresh, ["ecosystem", "name", "version"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    place = F.sum((~F.col("hit")).cast("int")).over(Window.partitionBy("request").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("source", F.when(F.col("hit"), "cache").when(place <= most, "fetch").otherwise("limit")).drop("hit")


def enriched(packages: DataFrame, details: DataFrame, most: int = 20) -> DataFrame:
    """Details of the first ``most`` advisories of each package, in their order; unknown ones keep their id only."""
    flat = packages.select("ecosystem", "name", "version", F.posexplode(F.slice("vulns", 1, most)).alias("pos", "id"))
    joined = flat.join(details, "id", "left")
    cols = [c for c in details.columns if c != "id"]
    return joined.groupBy("ecosystem", "name", "version").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", *cols))), lambda v: F.struct(v["id"].alias("id"), *(v[c].alias(c) for c in cols))).alias("vulns"))


def blocked_changes(changes: DataFrame, repos: DataFrame, blocked: DataFrame) -> DataFrame:
    """Changes (repo, author) whose author is blocked in the organisation of the repository."""
    return changes.join(repos.select("repo", "org_id"), "repo").join(blocked.select("org_id", F.col("login").alias("author")).distinct(), ["org_id", "author"], "left_semi")


def layer_details(scores: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """One row per score and layer out of the findings JSON of flat rows, with the columns' values as a fallback."""
    schema = "map<string, struct<justification: string, category: string, confidence: string, threat_nature: string>>"
    rows = scores.withColumn("j", F.from_json("findings_json", schema))
    cells = [F.struct(F.lit(x).alias("layer"), F.coalesce(f"{x}_score", F.lit(0)).alias("score"), F.coalesce(f"{x}_skipped", F.lit(True)).alias("skipped"), F.coalesce(F.nullif(F.col("j")[x]["justification"], F.lit("")), F.col("semantic_justification") if x == "semantic" else F.lit(None), F.lit("")).alias("justification"), F.coalesce(F.nullif(F.col("j")[x]["threat_nature"], F.lit("")), F.col("nature") if x == "static" else F.lit(None)).alias("nature")) for x in layers]
    return rows.select("event_id", F.explode(F.array(*cells)).alias("l")).select("event_id", "l.*")


def distinct_authors(commits: DataFrame, group: str = "diff_id") -> DataFrame:
    """The authors of a change by email, each as first seen."""
    return commits.groupBy(group, "email").agg(F.min_by(F.struct("name", "login"), "ord").alias("a"), F.min("ord").alias("ord")).select(group, "ord", "email", "a.name", "a.login")


def signs_commits(commits: DataFrame, key: str = "repo", last: int = 20) -> DataFrame:
    """Whether any of the last commits of a repository has a verified signature."""
    recent = commits.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc()))).filter(F.col("k") <= last)
    return recent.groupBy(key).agg(F.coalesce(F.bool_or("verified"), F.lit(False)).alias("signs"))


# --- source structure -------------------------------------------------------------------------------------------


def _python(content: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Line ranges of functions and classes, and imported modules; nothing if the text isn't Python."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    ranges = [(n.lineno, n.end_lineno or n.lineno) for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    names = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module}
    return ranges, sorted(names)


def python_structure(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``ranges`` array<struct<start, end>> and ``imports`` of Python files, by the language's own parser."""

    def parse(batch: pd.Series) -> pd.DataFrame:
        found = [_python(c or "") for c in batch]
        return pd.DataFrame({"ranges": [[{"start": a, "end": z} for a, z in r[0]] for r in found], "imports": [r[1] for r in found]})

    parse.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(parse, "struct<ranges: array<struct<start: int, end: int>>, imports: array<string>>").asNondeterministic()
    return files.withColumn("p", udf(F.col(content))).select(*files.columns, "p.ranges", "p.imports")


def indented_ranges(content: Column) -> Column:
    """array<struct<start, end>>: blocks that begin at unindented lines; comments and lines that only close a block don't begin one."""
    closing = ["end", "}", ")", "]", "end;", "end.", "end,"]
    begins = lambda x: F.rlike(x, F.lit(r"^\S")) & ~F.rlike(x, F.lit(r"^(#|//)")) & ~X.strip(x).isin(*closing)
    starts = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(begins(x), i + 1)), lambda i: i.isNotNull())
    until = lambda at, n: lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get(at, i + 1) - 1, n).alias("end"))
    none = F.array().cast("array<struct<start: int, end: int>>")
    return X.bound(X.lines(content), lambda ls: X.bound(starts(ls), lambda at: F.when(F.size(at) > 0, F.transform(at, until(at, F.size(ls)))).otherwise(none)))


def symbols(content: Column, ranges: Column) -> Column:
    """The first line of each range, stripped, at most 120 characters."""
    inside = lambda ls: F.filter(ranges, lambda r: (r["start"] >= 1) & (r["start"] <= F.size(ls)))
    return X.bound(X.lines(content), lambda ls: F.transform(inside(ls), lambda r: F.left(X.strip(F.element_at(ls, r["start"])), F.lit(120))))


def without_overlap(fragments: DataFrame, least: int = 20) -> DataFrame:
    """(case_id, ord, text): fragments without the text that an earlier one of the case ends or begins with.

    At least ``least`` characters count. The longest overlap with any earlier fragment goes, at the start rather than the end.
    """

    def cut(texts: list[str]) -> list[str]:
        out: list[str] = []
        for k, text in enumerate(texts):
            before = texts[:k]
            head = max((n for p in before for n in range(least, min(len(p), len(text)) + 1) if p.endswith(text[:n])), default=0)
            tail = max((n for p in before for n in range(least, min(len(p), len(text)) + 1) if p.startswith(text[-n:])), default=0)
            out.append(text[head:].lstrip() if head and head >= tail else text[:-tail].rstrip() if tail else text)
        return out

    @F.pandas_udf("array<string>")
    def cut_all(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(list(t)) for t in texts])

    # a case is one row, so that Python goes over many cases at a time
    cases = fragments.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "text"))).alias("f"))
    rows = cases.select("case_id", F.explode(F.arrays_zip(F.col("f.ord").alias("ord"), cut_all(F.col("f.text")).alias("text"))).alias("z"))
    return rows.select("case_id", "z.ord", "z.text")
