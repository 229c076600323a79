"""The semantic layer's results as a staged plan: budget, cache, calls, floors, and what is written back.

Nothing is asked twice: a change is known by a digest of its files, answers are kept by organisation and digest, and only
changes without a kept answer reach the model. The model itself is a parameter, a function of a table of calls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions import text as X
from ..functions.staging import staged
from ..operators import packing as P
from ..operators import review as R

#: What a kept answer holds; answers of another number are asked for again.
SCHEMA = 1
ANSWER = "struct<score: int, confidence: string, category: string, nature: string, justification: string>"
#: Fixed value: characters of each file or piece that a query for similar cases takes.
SUMMARY_CHARS = 200

#: Takes calls (diff_id, call, kind, sample, prompt) and adds answer (ANSWER; null if it can't be read), fetched (array of
#: paths) and fetched_text. kind: single, map or reduce; sample: 0, or which repetition of the call this is.
Evaluate = Callable[[DataFrame], DataFrame]


@dataclass
class Outcome:
    """``results`` (diff_id, org, repo, digest, status, score, confidence, category, nature, justification, tokens, skipped), one
    row for each request; ``answers`` and ``usage``: rows to add to the cache and to the ledger."""

    results: DataFrame
    answers: DataFrame
    usage: DataFrame


def digests(files: DataFrame) -> DataFrame:
    """(diff_id, digest, tokens, summary): the same files, in whatever order, have the same digest.

    ``files`` (diff_id, ord, path, status, diff_hunk). ``summary`` is the query for similar cases: the path and the first
    characters of each file. Only hashes and beginnings of a change's files meet in one row.
    """
    hunk = F.coalesce("diff_hunk", F.lit(""))
    mark = F.concat(F.sha2("path", 256), F.sha2(hunk, 256), F.coalesce("status", F.lit("")))
    head = F.concat("path", F.lit(": "), F.substr(hunk, F.lit(1), F.lit(SUMMARY_CHARS)))
    by_ord = F.array_sort(F.collect_list(F.struct("ord", "path", head.alias("head"))))
    return files.groupBy("diff_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(mark)), ";"), 256).alias("digest"), F.sum(X.token_estimate(hunk)).cast("long").alias("tokens"), F.array_join(F.transform(by_ord, lambda x: x["head"]), "\n").alias("summary")
    )


def piece_summary(pieces: DataFrame, keys: list[str], order: str = "part") -> DataFrame:
    """(keys, summary): the query for similar cases of a chunk of pieces (keys, path, content): the beginning of each piece."""
    head = F.substr(F.coalesce("content", F.lit("")), F.lit(1), F.lit(SUMMARY_CHARS))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", order, head.alias("h")))), lambda x: x["h"]), "\n").alias("summary"))


def judged(requests: DataFrame, digest: DataFrame, cache: DataFrame, ledger: DataFrame, limits: DataFrame, month: str, schema: int = SCHEMA) -> DataFrame:
    """Adds digest, tokens, kept (the kept answer or null), first and status (budget, hit or miss) to ``requests``.

    ``requests`` (diff_id, org, repo, ord) are taken in the order of ``ord`` within a repository: a change is out of budget if
    what was used this month, and what the misses before it use, leaves nothing. The first change of a repository with a
    digest is the miss; later ones with the same digest are hits of its answer. A repository without a row in
    ``limits`` (repo, budget), or with a null budget, has no limit.
    """
    kept = cache.filter(F.col("schema") == schema).groupBy("org", "digest").agg(F.max(F.struct("score", "confidence", "category", "nature", "justification")).alias("kept"))
    used = ledger.filter(F.col("month") == month).groupBy("repo").agg(F.sum("tokens").alias("used"))
    none = F.sha2(F.lit(""), 256)
    rows = requests.select("diff_id", "org", "repo", "ord").join(digest.select("diff_id", "digest", "tokens"), "diff_id", "left")
    rows = rows.withColumns({"digest": F.coalesce("digest", none), "tokens": F.coalesce("tokens", F.lit(0).cast("long"))})
    rows = rows.join(kept, ["org", "digest"], "left").join(used, "repo", "left").join(limits.groupBy("repo").agg(F.max("budget").alias("budget")), "repo", "left")
    same = Window.partitionBy("org", "repo", "digest").orderBy("ord", "diff_id")
    before = Window.partitionBy("repo").orderBy("ord", "diff_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.first("diff_id").over(same))
    asks = F.col("kept").isNull() & (F.col("first") == F.col("diff_id"))
    spent = F.coalesce("used", F.lit(0)) + F.coalesce(F.sum(F.when(asks, F.col("tokens")).otherwise(F.lit(0))).over(before), F.lit(0))
    out = F.coalesce(S.budget_left(F.col("budget"), F.lit(0)) - spent <= 0, F.lit(False))
    return rows.withColumn("status", F.when(out, "budget").when(asks, "miss").otherwise("hit")).drop("used", "budget")


def _prompt(path: Column, content: Column) -> Column:
    return F.concat(F.lit("--- "), path, F.lit(" ---\n"), content)


def calls_of(files: DataFrame, edges: DataFrame | None, max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(calls, unseen): single calls of changes that fit, and one map call for each chunk of the others; paths that found no chunk.

    A chunk's paths come with its call. Only pieces of one chunk, which ``max_tokens`` bounds, or files of one change that
    fits, meet in one row.
    """
    rows = files.select("diff_id", "ord", "path", F.coalesce("diff_hunk", F.lit("")).alias("content"))
    rows = rows.withColumn("total", F.sum(X.token_estimate(F.col("content"))).over(Window.partitionBy("diff_id")))
    each = lambda x: _prompt(x["path"], x["content"])
    texts = F.array_sort(F.collect_list(F.struct("ord", "part", "path", "content")))
    small = rows.filter(F.col("total") <= max_tokens).withColumn("part", F.lit(0)).groupBy("diff_id").agg(texts.alias("t"))
    single = small.select("diff_id", F.lit(0).alias("call"), F.lit("single").alias("kind"), F.array_join(F.transform("t", each), "\n").alias("prompt"), F.transform("t", lambda x: x["path"]).alias("paths"))
    none = F.array().cast("array<struct<start: int, end: int>>")
    pieces = staged(P.file_pieces(rows.filter(F.col("total") > max_tokens).withColumn("ranges", none), max_tokens))
    links = edges if edges is not None else pieces.select("diff_id", F.col("path").alias("a"), F.col("path").alias("b")).limit(0)
    placed = staged(P.pack_pieces(pieces, links, max_tokens))
    packed = placed.filter("chunk IS NOT NULL").select("diff_id", "path", "part", "chunk").join(pieces.select("diff_id", "path", "part", "ord", "content"), ["diff_id", "path", "part"])
    chunk = packed.groupBy("diff_id", "chunk").agg(texts.alias("t"))
    mapped = chunk.select("diff_id", F.col("chunk").alias("call"), F.lit("map").alias("kind"), F.array_join(F.transform("t", each), "\n").alias("prompt"), F.array_distinct(F.transform("t", lambda x: x["path"])).alias("paths"))
    unseen = placed.filter("chunk IS NULL").select("diff_id", "path").distinct()
    return single.unionByName(mapped), unseen


def synthesis_calls(answers: DataFrame, unseen: DataFrame) -> DataFrame:
    """(diff_id, call, kind, prompt): one call for each change in chunks, from their answers and not from the files again."""
    line = F.concat(F.array_join("paths", ", "), F.lit(": "), F.coalesce(F.col("answer.score").cast("string"), F.lit("no answer")), F.lit(" "), F.coalesce("answer.justification", F.lit("")))
    said = answers.filter("kind = 'map'").groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("call", line.alias("line")))).alias("l"))
    left = unseen.groupBy("diff_id").agg(F.array_sort(F.collect_set("path")).alias("left"))
    text = F.array_join(F.concat(F.transform("l", lambda x: x["line"]), F.transform(F.coalesce("left", F.array().cast("array<string>")), lambda p: F.concat(F.lit("not seen: "), p))), "\n")
    return said.join(left, "diff_id", "left").select("diff_id", F.lit(1 << 20).alias("call"), F.lit("reduce").alias("kind"), text.alias("prompt"))


def semantic_results(requests: DataFrame, files: DataFrame, cache: DataFrame, ledger: DataFrame, limits: DataFrame, evaluate: Evaluate, month: str, edges: DataFrame | None = None, max_tokens: int = P.MAX_TOKENS, schema: int = SCHEMA) -> Outcome:
    """Results of all ``requests`` (see ``judged``), whose ``files`` are (diff_id, ord, path, status, diff_hunk).

    ``cache`` (org, digest, schema, score, confidence, category, nature, justification), ``ledger`` (org, repo, month, digest,
    tokens). Status: ``budget`` (skipped), ``hit``, ``single``, ``chunked``, or ``failed`` (skipped: a single or synthesis
    call without a readable answer; it isn't kept). A change in chunks has the highest score of its chunks and of the
    synthesis, the first of equal ones, with the synthesis's reason as a note if a chunk won; a score near a threshold is
    asked for again. Text that is built to be taken for an answer then raises it to 100 (files and what was fetched are
    searched, not the synthesis prompt), after that unseen content raises it, unless one of its paths was fetched. Chunks
    without an answer count as unseen.

    A digest's tokens are those of its files; they are known before any call. A rerun with ``answers`` added to the cache
    and ``usage`` to the ledger adds nothing: ledger rows are known by (org, repo, month, digest).
    """
    rows = staged(judged(requests, digests(files), cache, ledger, limits, month, schema))
    misses = rows.filter("status = 'miss'").select("diff_id")
    calls, unseen = calls_of(files.join(misses, "diff_id", "left_semi"), edges, max_tokens)
    said = staged(evaluate(calls.withColumn("sample", F.lit(0))))
    lost = said.filter("kind = 'map' AND answer IS NULL").select("diff_id", F.explode("paths").alias("path"))
    unseen = staged(unseen.unionByName(lost).distinct())
    both = said.select("diff_id", "call", "kind", "prompt", "answer", "fetched", "fetched_text").unionByName(staged(evaluate(synthesis_calls(said, unseen).withColumn("sample", F.lit(0)))).select("diff_id", "call", "kind", "prompt", "answer", "fetched", "fetched_text"))
    both = staged(both)
    best = both.filter("answer IS NOT NULL").groupBy("diff_id").agg(F.max_by(F.struct("call", "kind", "prompt", "answer"), F.struct("answer.score", -F.col("call"))).alias("w")).select("diff_id", "w.*")
    near = best.filter(S.borderline(F.col("answer.score")))
    samples = staged(evaluate(near.select("diff_id", "call", "kind", "prompt", F.explode(F.sequence(F.lit(1), F.lit(K.RESAMPLES))).alias("sample"))))
    scored = R.winning_call(both.filter("answer IS NOT NULL").select("diff_id", F.col("call").alias("ord"), F.col("answer.score").alias("score")), samples.select("diff_id", F.col("sample").alias("k"), F.col("answer.score").alias("score")))

    empty = F.array().cast("array<string>")
    read = F.when(F.col("kind") == "reduce", F.lit("")).otherwise(F.col("prompt"))
    labels = F.array_union(X.injection_labels(read), X.injection_labels(F.coalesce("fetched_text", F.lit(""))))
    seen = both.unionByName(samples.select("diff_id", "call", F.lit("reduce").alias("kind"), F.lit("").alias("prompt"), "answer", "fetched", "fetched_text"))
    scanned = seen.groupBy("diff_id").agg(F.array_distinct(F.flatten(F.collect_list(labels))).alias("labels"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("fetched", empty)))).alias("fetched"))
    broken = both.filter("answer IS NULL AND kind <> 'map'").select("diff_id").distinct().withColumn("broken", F.lit(True))
    notes = both.filter("kind = 'reduce'").select("diff_id", F.col("answer.justification").alias("note"))
    open_paths = unseen.groupBy("diff_id").agg(F.collect_set("path").alias("unverified"))
    out = misses.join(best.select("diff_id", "kind", "answer"), "diff_id", "left").join(scored.select("diff_id", F.col("score").alias("top")), "diff_id", "left")
    for more in (scanned, broken, notes, open_paths):
        out = out.join(more, "diff_id", "left")
    floored = S.injection_floor(F.col("top"), F.coalesce("labels", empty))
    unread = F.coalesce("unverified", empty)
    score = S.unverified_floor(floored, unread, F.coalesce("fetched", empty))
    raised = score > floored
    failed = F.coalesce("broken", F.lit(False)) | F.col("answer").isNull()
    reason = F.when((F.col("kind") == "map") & F.col("note").isNotNull(), F.concat("answer.justification", F.lit(" [synthesis: "), "note", F.lit("]"))).otherwise(F.col("answer.justification"))
    fresh = out.select(
        "diff_id",
        F.when(failed, "failed").when(F.col("kind") == "single", "single").otherwise("chunked").alias("state"),
        F.when(~failed, score.cast("int")).alias("score"),
        F.col("answer.confidence").alias("confidence"),
        F.when(floored > F.col("top"), "OFUSCACION").otherwise(F.col("answer.category")).alias("category"),
        F.when(raised, K.UNCERTAIN).when(floored > F.col("top"), K.MALICIOUS).otherwise(F.col("answer.nature")).alias("nature"),
        reason.alias("justification"),
    )
    fresh = staged(fresh)
    value = F.struct("score", "confidence", "category", "nature", "justification")
    own = fresh.filter("state <> 'failed'").select("diff_id", "state", value.alias("asked"))
    answers = rows.filter("status = 'miss'").join(own, "diff_id").groupBy("org", "digest").agg(F.min_by("asked", F.struct("ord", "diff_id")).alias("a")).select("org", "digest", F.lit(schema).alias("schema"), "a.*")
    usage = rows.filter("status = 'miss'").join(own.select("diff_id"), "diff_id").select("org", "repo", F.lit(month).alias("month"), "digest", "tokens")
    # later changes of a repository with the digest of a miss have its answer
    shared = own.select(F.col("diff_id").alias("first"), "state", "asked")
    joined = rows.join(shared, "first", "left")
    chosen = F.when(F.col("status") != "budget", F.coalesce("kept", "asked"))
    status = F.when(F.col("status") == "miss", F.coalesce("state", F.lit("failed"))).when((F.col("status") == "hit") & F.col("kept").isNull() & F.col("asked").isNull(), "failed").otherwise(F.col("status"))
    rest = joined.select("diff_id", "org", "repo", "digest", status.alias("status"), chosen.alias("c"), "tokens")
    results = rest.select("diff_id", "org", "repo", "digest", "status", F.coalesce("c.score", F.lit(0)).alias("score"), "c.confidence", "c.category", "c.nature", F.coalesce("c.justification", F.lit("")).alias("justification"), "tokens", F.col("c").isNull().alias("skipped"))
    return Outcome(results, answers, usage)


def with_answers(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers, which replace stale ones of their key."""
    return cache.join(answers.select("org", "digest"), ["org", "digest"], "left_anti").select(*cache.columns).unionByName(answers.select(*cache.columns))


def with_usage(ledger: DataFrame, usage: DataFrame) -> DataFrame:
    """The ledger with new rows; one that is there already (a rerun after a loss) isn't added again."""
    keys = ["org", "repo", "month", "digest"]
    return ledger.unionByName(usage.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti").select(*ledger.columns))
