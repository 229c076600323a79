"""Expressions over paths, hunks and free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; a break at the end starts no further line, and an empty text has none."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(bound(F.split(text, _BREAKS, -1), whole))


def strip(text: Column) -> Column:
    """Without white space at both ends (all ASCII white space, not only spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension with its dot; null without a dot."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1)))


def stem(path: Column) -> Column:
    return F.substring_index(basename(path), ".", 1)


def language(path: Column) -> Column:
    """By file name, else by extension with its case; null if neither is known."""
    return F.coalesce(literal_map(K.LANGUAGE_OF_FILENAME)[basename(path)], literal_map(K.LANGUAGE_OF_EXTENSION)[extension(path)])


def rule_language(path: Column) -> Column:
    """The language that picks scanning rules: Dockerfile names in any form, else the lower-cased extension."""
    name = F.lower(basename(path))
    docker = (name == "dockerfile") | F.startswith(name, F.lit("dockerfile.")) | F.endswith(name, F.lit(".dockerfile"))
    return F.when(docker, "dockerfile").otherwise(literal_map(K.RULE_LANGUAGE_OF_EXTENSION)[F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))])


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*K.MANIFESTS)


def scannable(status: Column, binary: Column, hunk: Column) -> Column:
    return (status != "deleted") & ~binary & (strip(hunk) != "")


def change_status(new: Column, deleted: Column, renamed: Column) -> Column:
    return F.when(new, "added").when(deleted, "deleted").when(renamed, "renamed").otherwise("modified")


def line_counts(hunk: Column) -> tuple[Column, Column]:
    """(additions, deletions): lines after the first ``@@`` line that begin with one sign but not with three."""
    start = lambda ls: F.coalesce(F.array_position(F.transform(ls, lambda x: F.startswith(x, F.lit("@@"))), True), F.lit(0)).cast("int")
    signed = lambda sign: lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3))
    after = lambda ls, sign: bound(start(ls), lambda at: F.when(at > 0, F.size(F.filter(F.slice(ls, at, F.size(ls)), signed(sign)))).otherwise(F.when(ls.isNotNull(), 0)))
    count = lambda sign: bound(lines(hunk), lambda ls: after(ls, sign))
    return count("+"), count("-")


def new_content(hunk: Column) -> Column:
    """The new version as far as a hunk shows it: added and context lines without their first character."""
    heads = ("@@", "--- ", "+++ ")
    keep = lambda x: (F.startswith(x, F.lit("+")) | F.startswith(x, F.lit(" "))) & ~(F.startswith(x, F.lit(heads[0])) | F.startswith(x, F.lit(heads[1])) | F.startswith(x, F.lit(heads[2])))
    return F.array_join(F.transform(F.filter(lines(hunk), keep), lambda x: F.substr(x, F.lit(2))), "\n")


def added_lines(hunk: Column) -> Column:
    """array<struct<line, text>>: added lines with their 1-based number in the hunk."""
    numbered = F.transform(lines(hunk), lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw")))
    added = F.filter(numbered, lambda x: F.startswith(x["raw"], F.lit("+")) & ~F.startswith(x["raw"], F.lit("++")))
    return F.transform(added, lambda x: F.struct(x["line"].alias("line"), F.substr(x["raw"], F.lit(2)).alias("text")))


def suspicious_labels(text: Column) -> Column:
    """Labels of the suspicious patterns in a text, in their fixed order; none for null."""
    return F.array_compact(F.array(*(F.when(F.rlike(text, F.lit("(?i)" + p)), F.lit(label)) for p, label in K.SUSPICIOUS)))


def suspicious_lines(text: Column) -> Column:
    """0-based numbers of the lines with any suspicious pattern."""
    pattern = F.lit("(?i)" + "|".join(f"(?:{p})" for p, _ in K.SUSPICIOUS))
    return F.filter(F.transform(lines(text), lambda x, i: F.when(F.rlike(x, pattern), i)), lambda i: i.isNotNull())


def roles(text: Column) -> Column:
    """The different roles that begin a line of a pretended conversation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(K.ROLE_LINE), 1), lambda x: F.lower(x)))


def injection_labels(text: Column) -> Column:
    """Labels of attempts to instruct the analyser, in their fixed order."""
    found = [F.when(F.size(roles(text)) >= 2 if p is None else F.rlike(text, F.lit(p)), F.lit(label)) for p, label in K.INJECTION]
    return F.array_compact(F.array(*found))


def notable_literals(text: Column) -> Column:
    """Distinct URLs, dotted quads, long base64 and long hex strings."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), 0) for p in K.NOTABLE_LITERALS)))


def import_specifiers(content: Column, language_: Column) -> Column:
    """Names after import, from, require, use and include statements, by simple patterns."""
    patterns = {
        "python": [r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import"],
        "javascript": [r"""(?m)(?:from|import)\s+['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""],
        "go": [r"""(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$"""],
        "rust": [r"(?m)^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)"],
        "java": [r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"],
        "c": [r"""(?m)^\s*#\s*include\s+[<"]([^>"]+)[>"]"""],
        "ruby": [r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""],
    }
    patterns |= {"typescript": patterns["javascript"], "cpp": patterns["c"]}
    out = F.array().cast("array<string>")
    for name, ps in patterns.items():
        out = F.when(language_ == name, F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(content, F.lit(p), 1) for p in ps))))).otherwise(out)
    return out


def redact(text: Column) -> Column:
    for p in K.SECRETS:
        text = F.regexp_replace(text, p, K.REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return text


def digits_number(text: Column) -> Column:
    """All digits of a text as one number; 0 without any."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("long"), F.lit(0))


def should_index(path: Column, size: Column) -> Column:
    """Worth a place in the repository map: small enough, not under an excluded folder, no excluded suffix."""
    segments = F.split(path, "/")
    inside = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    suffix = F.rlike(F.lower(path), F.lit("(" + "|".join(s.replace(".", r"\.") for s in K.EXCLUDED_SUFFIXES) + ")$"))
    return (size <= K.MAX_INDEXED_BYTES) & ~F.arrays_overlap(inside, F.array(*(F.lit(d) for d in K.EXCLUDED_DIRS))) & ~suffix


def sarif_path(path: Column) -> Column:
    """A path relative to the repository: no scheme, drive or ``.`` and ``..`` parts; ``repository`` if nothing is left."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    clean = F.when(F.contains(clean, F.lit(":")) & ~F.startswith(clean, F.lit("http")), F.regexp_replace(clean, r"^[^:]*:", "")).otherwise(clean)
    joined = F.array_join(F.filter(F.split(clean, "/"), lambda p: ~p.isin("", ".", "..")), "/")
    return F.when(joined == "", "repository").otherwise(joined)


def escape_data(text: Column) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_property(text: Column) -> Column:
    return F.replace(F.replace(escape_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for the empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def direct_url(version: Column) -> Column:
    """Whether an npm version names a place instead of a release."""
    v = F.lower(version)
    return F.rlike(v, F.lit(r"^(git\+|git://|https?://|file:|github:|bitbucket:|gitlab:)|github\.com|(\.tgz|\.tar\.gz|\.git)$"))


def first_json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without both."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)
