"""URL filters: explicit host and path rules, else empirical-Bayes host reputation (DataFrame operations only).

Labelled page outcomes are counted by host, registered domain and suffix. From the suffix down, each level's rate is
shrunk to its parent's by a beta prior whose strength comes from the spread of the rates on that level (moments of
the beta-binomial). A host is blocked if the upper posterior bound of its rate of good pages is under a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_groups, staged

#: (host, path, verdict); fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
Z = 1.645
MIN_RATE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def levels(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix): the last label, or the longest of ``suffixes`` (such as ``co.uk``) that fits, and one label more."""
    bare = F.regexp_replace(host, r":\d*$", "")
    suffix = F.substring_index(bare, ".", -1)
    for s in sorted(suffixes, key=len):
        suffix = F.when((bare == s) | F.endswith(bare, F.lit("." + s)), F.lit(s)).otherwise(suffix)
    extra = F.size(F.split(suffix, r"\.")) + 1
    parts = F.split(bare, r"\.")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - extra + 1, F.lit(1)), extra), ".")
    return domain, suffix


def _strength(children: DataFrame) -> float:
    """Prior strength from children with ``good`` of ``n`` and the parent's ``m``: 1 / rho - 1, rho by moments, within 1 to 1000."""
    v = F.col("m") * (1 - F.col("m"))
    row = children.filter("n > 0").agg(F.sum(F.pow(F.col("good") / F.col("n") - F.col("m"), 2) * F.col("n")), F.sum(v), F.sum(v * (F.col("n") - 1))).first()
    spread, expected, more = (float(x or 0.0) for x in row)
    rho = (spread - expected) / more if more > 0 else 0.0
    return min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0


def reputations(outcomes: DataFrame, hosts: DataFrame, suffixes: tuple[str, ...] = (), z: float = Z) -> DataFrame:
    """(host, lower, upper): posterior bounds of the rate of good pages of each of ``hosts`` (distinct ``host``).

    ``outcomes``: (host, good 0/1), one row for each labelled page. Every level is one partial aggregation.
    """
    domain, suffix = levels(F.col("host"), suffixes)
    counts = outcomes.filter("good IS NOT NULL").groupBy("host").agg(F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    by_host = hosts.join(counts, "host", "left").fillna(0.0, ["good", "n"]).withColumns({"domain": domain, "suffix": suffix})
    by_host = staged(by_host, "hosts")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    by_suffix = by_host.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    good, n = by_suffix.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    by_suffix = by_suffix.withColumn("m", F.lit((good + 1) / (n + 2)))
    parent = None
    for frame, key in ((by_suffix, "suffix"), (by_domain, "domain"), (by_host, "host")):
        level = frame if parent is None else frame.join(parent, "suffix" if key == "domain" else ["domain", "suffix"])
        level = staged(level, key)
        s = _strength(level)
        a, b = F.col("good") + s * F.col("m"), F.col("n") - F.col("good") + s * (1 - F.col("m"))
        level = level.withColumns({"a": a, "b": b})
        parent = level.select(*(["suffix"] if key == "suffix" else ["domain", "suffix"]), (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    total = F.col("a") + F.col("b")
    mean, sd = F.col("a") / total, F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return level.select("host", (mean - z * sd).alias("lower"), (mean + z * sd).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", outcome_id_col: str = "page_id", good_col: str = "good", rules: list[tuple[str, str, str]] = RULES, min_rate: float = MIN_RATE) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, upper.

    ``outcomes``: labelled pages (id, good 0/1 or null). A null url, or one without ``://``, has an empty host and
    path; such pages form one host. Hosts without any labelled page get their domain's rate with a wide bound. A
    page's own labels count for its host like all others. Other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = staged(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "pages")
    marks = outcomes.select(F.col(outcome_id_col).alias("id"), F.col(good_col).cast("int").alias("good")).filter("id IS NOT NULL AND good IS NOT NULL")
    marked = rows.select("id", "host").join(marks.hint("merge"), "id").select("host", "good")
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host_sizes")
    bounds = reputations(marked, hosts.select("host")).join(hosts, "host")
    judged = join_groups(rows, staged(bounds, "bounds"), "host", "pages", rows.count())
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return judged.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("upper") < min_rate, "block").otherwise("allow")).alias("verdict"), "upper")
