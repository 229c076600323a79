"""What people and the model write: reviews, roles, proposed rules, cached answers, stored graphs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import scoring as S
from ..functions import text as X
from ..functions.staging import expanded, member_lists, spread, staged

#: Bytes of rule strings that are searched for in one pass.
RULE_BYTES = 16 << 20
#: Texts that are Python strings at once in a task.
TEXT_ROWS = 256


def login(name: Column) -> Column:
    """A login in the one form in which it is stored and compared."""
    return F.lower(X.strip(name))


def reviewed(scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """``scores`` (event_id, human_feedback, ...) with human_feedback, accepted_by, accepted_at after a log of ``reviews``.

    The log has event_id, ord, action, value and at. ``feedback`` sets the feedback; ``accept`` notes who (value) and
    when; ``clear`` takes that back. The last of either kind counts; one log is one row for each score before the join.
    Entries for unknown scores have no effect.
    """
    mark = F.when(F.col("action") == "feedback", F.col("ord"))
    accept = F.when(F.col("action").isin("accept", "clear"), F.col("ord"))
    last = reviews.groupBy("event_id").agg(F.max_by(F.struct("value"), mark).alias("_mark"), F.max_by(F.struct("action", "value", "at"), accept).alias("_accept"))
    kept = F.col("_accept.action") == "accept"
    return (
        scores.join(last, "event_id", "left")
        .withColumn("human_feedback", F.when(F.col("_mark").isNotNull(), F.col("_mark.value")).otherwise(F.col("human_feedback")))
        .withColumn("accepted_by", F.when(kept, login(F.col("_accept.value"))))
        .withColumn("accepted_at", F.when(kept, F.col("_accept.at")))
        .drop("_mark", "_accept")
    )


def violations(scores: DataFrame, roles: DataFrame) -> DataFrame:
    """(rule, key, n): what breaks the stored tables' constraints: unknown feedback, unknown role, a login with two roles in a repository."""
    feedback = scores.filter(~F.col("human_feedback").isin(*K.FEEDBACK_VALUES)).select(F.lit("feedback").alias("rule"), F.col("event_id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    key = F.concat_ws("@", "user_login", "repo").alias("key")
    role = roles.filter(~F.col("role").isin(*K.ROLE_VALUES)).groupBy(F.lit("role").alias("rule"), key).agg(F.count(F.lit(1)).alias("n"))
    twice = roles.groupBy(F.lit("unique_role").alias("rule"), key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return feedback.unionByName(role).unionByName(twice)


def highest_role(roles: DataFrame) -> DataFrame:
    """(user_login, role): the highest role that a login has in any repository."""
    top = F.max((F.col("role") == K.ROLE_VALUES[0]).cast("int"))
    return roles.groupBy(login(F.col("user_login")).alias("user_login")).agg(F.when(top == 1, K.ROLE_VALUES[0]).otherwise(K.ROLE_VALUES[1]).alias("role"))


def declared_rules(source: Column) -> Column:
    """Names of the rules that a rule text declares."""
    return F.regexp_extract_all(source, F.lit(K.RULE_DECLARATION), 1)


def rule_problem(name: Column, category: Column, source: Column, rationale: Column) -> Column:
    """The first reason to refuse a proposed rule: name, category, size, rationale, count or identifier; null if there is none."""
    names = declared_rules(source)
    bad = lambda c, p: ~F.coalesce(F.rlike(c, F.lit(p)), F.lit(False))
    return (
        F.when(bad(name, K.RULE_NAME), "name")
        .when(bad(category, K.RULE_CATEGORY), "category")
        .when(F.length(source) > K.MAX_RULE_CHARS, "size")
        .when(F.coalesce(X.strip(rationale), F.lit("")) == "", "rationale")
        .when(F.coalesce(F.size(names), F.lit(0)) != 1, "count")
        .when(names[0] != name, "identifier")
    )


def text_rules(sources: DataFrame) -> DataFrame:
    """(rule_id, strings array<struct<text, nocase>>, needed, score) of rule texts (category, source) with plain strings only.

    ``needed`` is how many different strings must occur: ``any``, ``all`` or a number ``of them``. Rules of other forms
    (expressions, hex strings, conditions over sizes) need an engine of their own and are left out. A rule that states no
    whole risk_score has the default. The sources are dealt to all tasks before they are taken apart.
    """
    sources = spread(sources.select("category", "source"))
    wholes = F.regexp_extract_all("source", F.lit(r'\$\w*\s*=\s*("(?:[^"\\\n]|\\.)*"(?:[ \t]+nocase\b)?)'), 1)
    text = lambda x: F.replace(F.replace(F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    strings = F.transform(wholes, lambda x: F.struct(text(x).alias("text"), F.endswith(x, F.lit("nocase")).alias("nocase")))
    how = F.regexp_extract("source", r"condition\s*:\s*(any|all|\d+)\s+of\s+them\s*\}", 1)
    n = F.size(F.regexp_extract_all("source", F.lit(r"\$\w*\s*="), 0))
    needed = F.when(how == "any", F.lit(1)).when(how == "all", F.size(strings)).otherwise(how.try_cast("int"))
    score = F.coalesce(F.regexp_extract("source", r"risk_score\s*=\s*(\d+)\b", 1).try_cast("int"), F.lit(K.DEFAULT_RULE_SCORE))
    rows = sources.filter(F.size(declared_rules(F.col("source"))) == 1).select(F.concat_ws(".", "category", declared_rules(F.col("source"))[0]).alias("rule_id"), strings.alias("strings"), needed.alias("needed"), score.alias("score"), n.alias("_n"))
    return rows.filter((F.col("_n") == F.size("strings")) & (F.col("_n") > 0) & F.col("needed").between(1, F.size("strings"))).drop("_n")


def _automata(rules: list[tuple[str, int, list[tuple[str, bool]]]]):
    """(exact, without case): automata whose strings carry the rules they belong to, as (rule, place of the string in it)."""
    import ahocorasick

    both: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for r, (_, _, strings) in enumerate(rules):
        for k, (text, nocase) in enumerate(strings):
            if text:
                both[nocase].setdefault(text.lower() if nocase else text, []).append((r, k))
    out = []
    for owners in both:
        automaton = ahocorasick.Automaton()
        for text, places in owners.items():
            automaton.add_word(text, places)
        if owners:
            automaton.make_automaton()
        out.append(automaton if owners else None)
    return out


def _found(text: str, automata: list) -> dict[int, set[int]]:
    """The strings of each rule that occur in ``text``."""
    found: dict[int, set[int]] = {}
    for automaton, t in zip(automata, (text, text.lower()), strict=True):
        if automaton is not None:
            for _, places in automaton.iter(t):
                for r, k in places:
                    found.setdefault(r, set()).add(k)
    return found


def text_rule_hits(texts: DataFrame, rules: DataFrame, id_cols: list[str], text_col: str, part_bytes: int = RULE_BYTES) -> DataFrame:
    """(ids, rule_id, score): texts in which enough different strings of a rule occur. ``rules``: from ``text_rules``.

    Rules with the same strings and the same ``needed`` are one class, of which a text has one hit; the class's rules come
    back by a join on its digest, after the search. All strings of all classes are searched at once: each task builds an
    automaton of them and goes over a text once, however many rules there are, so the plan doesn't grow with them. Rules are
    configuration. Classes are sent in parts of about ``part_bytes`` of strings, each with whole classes and a pass of its own; a
    common catalogue is one part. Null texts are empty; the empty string occurs in every text. Rows that repeat ids each
    give their hits.
    """
    spark, rows = texts.sparkSession, texts.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in id_cols), T.StructField("_class", T.StringType())])
    same = F.md5(F.to_json(F.struct("needed", "strings")))
    known = staged(rules.select(same.alias("_class"), "rule_id", F.col("score").cast("int").alias("score"), "needed", "strings"))
    classes = known.groupBy("_class").agg(F.first("needed").alias("needed"), F.first("strings").alias("strings"))

    def search(part: list[tuple[str, int, list[tuple[str, bool]]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = shared.value
            automata = _automata(given)
            always = [{k for k, (text, _) in enumerate(strings) if not text} for _, _, strings in given]
            free = [r for r, (_, needed, _) in enumerate(given) if len(always[r]) >= needed]
            for batch in (b.slice(x, TEXT_ROWS) for b in batches for x in range(0, b.num_rows, TEXT_ROWS)):
                at, which = [], []
                for i, text in enumerate(batch.column(len(id_cols)).to_pylist()):
                    found = _found(text, automata)
                    hits = {r for r, ks in found.items() if len(ks | always[r]) >= given[r][1]}.union(free)
                    at += [i] * len(hits)
                    which += sorted(hits)
                own = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([given[r][0] for r in which], pa.string())], names=schema.names)

        return rows.mapInArrow(run, schema)

    parts, size = [[]], 0
    for r in classes.toLocalIterator():
        own = sum(len(s.text.encode()) + 16 for s in r.strings)
        if parts[-1] and size + own > part_bytes:
            parts.append([])
            size = 0
        parts[-1].append((r["_class"], r.needed, [(s.text, s.nocase) for s in r.strings]))
        size += own
    hits = reduce(DataFrame.unionByName, [search(p) for p in parts])
    return expanded(hits, member_lists(known.select("_class", "rule_id", "score"), "_class"), "_class")


def benign_matches(rules: DataFrame, benign: DataFrame) -> DataFrame:
    """(rule_id, name): harmless texts (name, text) that a rule of ``rules`` (from ``text_rules``) matches: a warning that it is too broad.

    One pass over the texts checks all rules. A warning only: it decides nothing.
    """
    return text_rule_hits(benign, rules, ["name"], "text").select("rule_id", "name").distinct()


def approved_rules(stored: DataFrame) -> DataFrame:
    """(category, source) of the stored rules that were approved, as ``text_rules`` takes them."""
    return stored.filter(F.col("status") == "approved").select("category", "source")


def rule_queue(stored: DataFrame, status: str | None = None) -> DataFrame:
    """Stored rules, the newest first, of one status or all."""
    rows = stored if status is None else stored.filter(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), "rule_name")


def decided_rules(stored: DataFrame, decisions: DataFrame, admins: list[str]) -> DataFrame:
    """``stored`` (rule_name, category, source, rationale, status, ...) with status, reviewed_by and reviewed_at after ``decisions``.

    A decision (rule_name, ord, action approve or reject, reviewer, at) counts if it comes from one of ``admins`` and the
    rule is pending; the first that counts is final. A rule that isn't valid any more can't be approved, only rejected.
    """
    names = F.array(*(F.lit(a.strip().lower()) for a in admins if a.strip())) if admins else F.array().cast("array<string>")
    sound = rule_problem(F.col("rule_name"), F.col("category"), F.col("source"), F.col("rationale")).isNull()
    log = decisions.filter(F.col("action").isin("approve", "reject") & F.array_contains(names, login(F.col("reviewer"))))
    both = log.join(stored.filter("status = 'pending'").select("rule_name", sound.alias("_sound")), "rule_name").filter("action = 'reject' OR _sound")
    first = both.groupBy("rule_name").agg(F.min_by(F.struct("action", "reviewer", "at"), "ord").alias("_d"))
    done = F.col("_d").isNotNull() & (F.col("status") == "pending")
    return (
        stored.join(first, "rule_name", "left")
        .withColumn("reviewed_by", F.when(done, login(F.col("_d.reviewer"))))
        .withColumn("reviewed_at", F.when(done, F.col("_d.at")))
        .withColumn("status", F.when(done, F.when(F.col("_d.action") == "approve", "approved").otherwise("rejected")).otherwise(F.col("status")))
        .drop("_d")
    )


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``table`` with ``new`` rows in place of those with their keys; of several new ones the last by ``order`` counts."""
    rest = [c for c in table.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*table.columns)
    return table.join(last.select(*keys), keys, "left_anti").select(*table.columns).unionByName(last)


def replace_groups(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` with all rows of the keys in ``new`` replaced, as a rebuilt graph replaces its nodes or edges."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def union_edges(*graphs: DataFrame) -> DataFrame:
    """(diff_id, a, b), a < b: the edges that any graph has, once each, without self-loops."""
    both = reduce(DataFrame.unionByName, (g.select("diff_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for g in graphs))
    return both.filter("a < b").distinct()


def graph_view(repos: DataFrame, summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, status, overview, n_nodes, paths): each repository's graph; ``pending`` and no nodes where none was built."""
    found = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n_nodes"), F.array_sort(F.collect_list("path")).alias("paths"))
    out = repos.select("repo").join(summaries.select("repo", "status", "overview"), "repo", "left").join(found, "repo", "left")
    none = F.array().cast("array<string>")
    return out.select("repo", F.coalesce("status", F.lit("pending")).alias("status"), "overview", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("paths", none).alias("paths"))


def repo_overview(listed: DataFrame, monitored: DataFrame) -> DataFrame:
    """Repositories with results (``history.repo_list``) and monitored ones (repo, ord, monitor_type): all of either, with ``source``.

    A repository that is monitored twice has its first type. Without results the counts are 0.
    """
    kinds = monitored.groupBy("repo").agg(F.min_by("monitor_type", "ord").alias("kind"))
    counts = [c for c, t in listed.dtypes if c != "repo" and t in ("int", "bigint", "double")]
    out = listed.join(kinds, "repo", "full_outer").withColumn("source", F.when(F.col("kind") == "audited", "audited").otherwise("own")).drop("kind")
    return out.na.fill(0, counts)


def content_hash(files: DataFrame, group: str) -> DataFrame:
    """(group, hash): SHA-256 of the contents of a rule folder's files one after the other, in the order of their paths.

    ``files``: group, path, content (binary or string), is_link. A folder with a link has no hash (null): what it points
    to isn't part of it. One folder is one row, so this is for folders of rules, not for corpora.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", F.hex(F.col("content").cast("binary")).alias("h")))), lambda x: x["h"])
    digest = F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(parts, "")), 256))
    return files.groupBy(group).agg(F.bool_or("is_link").alias("_link"), digest.alias("hash")).select(group, F.when(~F.col("_link"), F.col("hash")).alias("hash"))


def brace_ranges(content: Column) -> Column:
    """array<struct<start, end>>: line ranges of a text's top-level blocks by balance of braces, 1-based.

    Braces in strings and comments don't count. A block ends with the line of the brace that closes it; what follows the
    last one is a range of its own.
    """
    quoted = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+(?:{q}|\\?\z)" for q in "'\"`")
    tokens = F.regexp_extract_all(content, F.lit(rf"(?s)/\*.*?(?:\*/|\z)|//[^\n]*+|{quoted}|[{{}}]|\n"), 0)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # a break behind a backslash in a string ends no line here
    moved = lambda x: F.when(F.rlike(x, F.lit("^['\"`]")), breaks(F.regexp_replace(x, r"(?s)\\.", ""))).otherwise(breaks(x))
    kind = "array<struct<start: int, end: int>>"
    begin = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("line"), F.lit(1).alias("start"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        closes = (x == "}") & (s["depth"] <= 1)
        depth = F.when(x == "{", s["depth"] + 1).when(x == "}", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        span = F.struct(s["start"].alias("start"), s["line"].alias("end"))
        return F.struct(depth.alias("depth"), (s["line"] + moved(x)).cast("int").alias("line"), F.when(closes, s["line"] + 1).otherwise(s["start"]).alias("start"), F.when(closes, F.array_append(s["out"], span)).otherwise(s["out"]).cast(kind).alias("out"))

    total = F.size(X.lines(content))

    def finish(s: Column) -> Column:
        tail = F.array(F.struct(s["start"].alias("start"), F.least(s["line"], total).alias("end"))).cast(kind)
        return F.when(s["start"] <= total, F.concat(s["out"], tail)).otherwise(s["out"])

    return F.aggregate(tokens, begin, step, finish)


def unverified_paths(prompt: Column) -> Column:
    """Distinct paths that a rendered text marks as not verified, in order."""
    mark = K.UNVERIFIED.replace("[", r"\[").replace("]", r"\]")
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"--- ([^\n]+?): [^\n]*?" + mark), 1))


def budgeted_fill(files: DataFrame, budget: int, group: str = "diff_id", head_tokens: int = 0) -> DataFrame:
    """``form`` of each file of a change that doesn't fit whole: whole, excerpt, unverified or no_budget.

    ``files`` (group, place from ``packing.truncation_order``, flagged, n_matches, whole_tokens, excerpt_tokens,
    marker_tokens). Flagged files are always whole. Others give an excerpt around suspicious lines, or a marker without any,
    until the files before have used the budget; the rest is marked only. What is used never falls, so the files before
    the border have their usual form and a running sum finds it.
    """
    usual = F.when(F.col("flagged"), F.col("whole_tokens")).when(F.col("n_matches") > 0, F.col("excerpt_tokens")).otherwise(F.col("marker_tokens"))
    before = F.sum(usual).over(Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    spent = F.coalesce(before, F.lit(0)) + head_tokens >= budget
    form = F.when(F.col("flagged"), "whole").when(spent, "no_budget").when(F.col("n_matches") > 0, "excerpt").otherwise("unverified")
    return files.withColumn("form", form)


def excerpt(content: Column, matches: Column, before: int = 3, most: int = 60) -> Column:
    """The lines around ``matches`` (0-based, ascending), ``[...]`` between stretches; stretches that touch are one.

    A stretch is left out once those before it have ``most`` lines.
    """
    kind = "array<struct<a: int, z: int>>"
    n, last = F.size(X.lines(content)), F.lit(-1)
    each = F.transform(matches, lambda m: F.struct(F.greatest(F.lit(0), m - before).cast("int").alias("a"), F.least(n, m + before + 1).cast("int").alias("z")))

    def merge(out: Column, w: Column) -> Column:
        end = F.try_element_at(out, last)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(end["a"].alias("a"), F.greatest(end["z"], w["z"]).alias("z"))))
        return F.when((F.size(out) > 0) & (w["a"] <= end["z"]), joined).otherwise(F.array_append(out, w)).cast(kind)

    def fill(s: Column, w: Column) -> Column:
        taken = F.struct((s["used"] + w["z"] - w["a"]).alias("used"), F.array_append(s["out"], w).cast(kind).alias("out"))
        return F.when(s["used"] < most, taken).otherwise(s)

    stretches = F.aggregate(each, F.array().cast(kind), merge)
    kept = F.aggregate(stretches, F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("out")), fill, lambda s: s["out"])
    return X.bound(X.lines(content), lambda ls: F.array_join(F.transform(kept, lambda w: F.array_join(F.slice(ls, w["a"] + 1, w["z"] - w["a"]), "\n")), "\n[...]\n"))


def rendered(files: DataFrame) -> DataFrame:
    """Adds ``text``: how each file of ``budgeted_fill`` (path, status, diff_hunk, form) is shown to the model.

    Whole files and excerpts are wrapped as untrusted content; a file that isn't shown leaves a line with its path and the mark
    that ``unverified_paths`` looks for, so what wasn't read can be told from the text alone.
    """
    hunk = F.coalesce("diff_hunk", F.lit(""))
    head = F.concat(F.lit("--- "), "path", F.lit(" ("), F.coalesce("status", F.lit("")), F.lit(") ---\n"))
    n = F.when(hunk == "", 0).otherwise(F.length(hunk) - F.length(F.replace(hunk, F.lit("\n"), F.lit(""))) + 1)
    wrap = lambda t: F.concat(F.lit(K.UNTRUSTED_START + "\n"), t, F.lit("\n" + K.UNTRUSTED_END))
    matches = X.suspicious_lines(hunk)
    cut = F.concat(head, F.lit("["), n, F.lit(" lines, too long to show whole; an excerpt around "), F.size(matches), F.lit(" lines with known risk patterns follows, the rest wasn't read]\n"), wrap(excerpt(hunk, matches)))
    unseen = lambda why: F.concat(F.lit("--- "), "path", F.lit(": "), n, F.lit(f" lines not shown. {K.UNVERIFIED} {why} ---"))
    form = F.col("form")
    return files.withColumn("text", F.when(form == "whole", F.concat(head, wrap(hunk))).when(form == "excerpt", cut).when(form == "unverified", unseen("No known risk pattern was found by a quick scan, which is no review.")).otherwise(unseen("No budget was left to look at it.")))


def winning_call(calls: DataFrame, samples: DataFrame, group: str = "diff_id") -> DataFrame:
    """(group, ord, score, n_samples): the call with the highest score, the first of equal ones, asked again near a threshold.

    ``calls`` (group, ord, score): the parts' answers and the synthesis. ``samples`` (group, k, score): answers to the winner
    asked again, k from 1, score null where one couldn't be read. Up to RESAMPLES of them count if the winner lies near
    a threshold, and the highest score stays.
    """
    best = calls.groupBy(group).agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("w")).select(group, "w.*")
    again = samples.filter((F.col("k") <= K.RESAMPLES) & F.col("score").isNotNull()).groupBy(group).agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n"))
    near = S.borderline(F.col("score"))
    out = best.join(again, group, "left")
    return out.select(group, "ord", F.when(near, F.greatest("score", "top")).otherwise(F.col("score")).alias("score"), F.when(near, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("n_samples"))
