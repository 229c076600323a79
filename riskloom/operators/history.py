"""Analytics over stored scores. ``scores`` has: repo, pr_number, author, ts (ISO text), day, score, verdict, nature,
human_feedback, and for each layer <layer>_score and <layer>_skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.staging import staged
from ..functions.text import literal_map


def avg1(value: Column) -> Column:
    """Mean to one decimal, 0 without rows."""
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), 1)


def _lights() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in (K.GREEN_LIGHT, K.YELLOW_LIGHT, K.RED_LIGHT)]


def org_metrics(scores: DataFrame, layers: tuple[str, ...] = K.LAYERS) -> DataFrame:
    """One row over all scores. Pending: neither of the two feedback values. Layer means leave out skipped and missing scores."""
    fb = F.col("human_feedback")
    known = [x for x in layers if f"{x}_score" in scores.columns]
    return scores.agg(
        F.count(F.lit(1)).alias("total"),
        avg1(F.col("score")).alias("avg_score"),
        *_lights(),
        F.count_if(fb == "correcto").alias("feedback_correct"),
        F.count_if(fb == "falso_positivo").alias("feedback_fp"),
        F.count_if(~F.coalesce(fb.isin("correcto", "falso_positivo"), F.lit(False))).alias("feedback_pending"),
        *(avg1(F.when(~F.coalesce(F.col(f"{x}_skipped"), F.lit(False)), F.col(f"{x}_score"))).alias(f"avg_{x}") for x in known),
    )


def repo_metrics(scores: DataFrame) -> DataFrame:
    """One row per repository. Pending here: no feedback value at all."""
    return scores.groupBy("repo").agg(F.count(F.lit(1)).alias("prs"), avg1(F.col("score")).alias("avg_score"), *_lights(), F.count_if(F.col("human_feedback").isNull()).alias("feedback_pending"))


def daily_trend(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.substring("ts", 1, 10).alias("day")).agg(avg1(F.col("score")).alias("avg_score"), F.count(F.lit(1)).alias("prs"))


def author_breakdown(scores: DataFrame) -> DataFrame:
    """One row per author, empty ones as ``unknown``; the latest verdict by time, then number."""
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown"))
    return scores.groupBy(author.alias("author")).agg(F.count(F.lit(1)).alias("prs"), F.round(F.avg("score"), 0).cast("int").alias("avg_score"), *_lights(), F.max_by("verdict", F.struct("ts", "pr_number")).alias("latest"))


def latest_per(scores: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key by time, then number."""
    rest = [c for c in scores.columns if c not in keys]
    return scores.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "pr_number")).alias("r")).select(*keys, "r.*")


def nature_by_day(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.substring("ts", 1, 10).alias("day")).agg(*(F.count_if(F.col("nature") == n).alias(n) for n in (K.MALICIOUS, K.VULNERABILITY, K.UNCERTAIN)))


def summary_cards(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("prs"), avg1(F.col("score")).alias("avg_score"), F.count_if(F.col("verdict") == K.RED_LIGHT).alias("red"), F.count_if(F.col("human_feedback").isNull()).alias("pending"))


def repo_list(scores: DataFrame) -> DataFrame:
    """Repositories with mean, latest verdict, red, yellow and pending counts."""
    return scores.groupBy("repo").agg(F.count(F.lit(1)).alias("prs"), F.round(F.avg("score"), 0).cast("int").alias("avg_score"), F.max_by("verdict", F.struct("ts", "pr_number")).alias("latest"), F.count_if(F.col("verdict") == K.RED_LIGHT).alias("red"), F.count_if(F.col("verdict") == K.YELLOW_LIGHT).alias("yellow"), F.count_if(F.col("human_feedback").isNull()).alias("pending"))


def risk_order(verdict: Column) -> Column:
    """Sort key of verdicts, gravest first, unknown last."""
    return F.when(verdict == K.RED_LIGHT, 0).when(verdict == K.YELLOW_LIGHT, 1).when(verdict == K.GREEN_LIGHT, 2).otherwise(3)


def score_history(scores: DataFrame, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first, ties by number; the limit is the caller's page size."""
    rows = (scores.filter(F.col("repo") == repo) if repo is not None else scores).orderBy(F.col("ts").desc(), F.col("pr_number").desc())
    return rows.limit(limit) if limit is not None else rows


def agent_metrics(scores: DataFrame, usage: DataFrame, default: str = "default-agent") -> DataFrame:
    """(agent, prs, avg_score, tokens): scores of agents and tokens of users, whichever side has them.

    ``scores`` (agent, score): null and empty agents don't count. ``usage`` (user_id, tokens_used), months summed.
    Without any row on either side there is one row of zeros for ``default``.
    """
    a = scores.filter(F.coalesce(F.col("agent"), F.lit("")) != "").groupBy("agent").agg(F.count(F.lit(1)).alias("prs"), avg1(F.col("score")).alias("avg_score"))
    t = usage.groupBy(F.col("user_id").alias("agent")).agg(F.sum("tokens_used").alias("tokens"))
    both = a.join(t, "agent", "full_outer").select("agent", F.coalesce("prs", F.lit(0)).alias("prs"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    empty = both.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(default).alias("agent"), F.lit(0).cast("long").alias("prs"), F.lit(0.0).alias("avg_score"), F.lit(0).cast("long").alias("tokens"))
    return both.unionByName(empty)


def authors_with_prior_risk(changes: DataFrame, scores: DataFrame, least: int = K.RED) -> DataFrame:
    """Rows of ``changes`` (repo, pr_number, author) whose author has another change, anywhere, with a score of ``least`` or more.

    Each author's first two risky changes decide: if the row itself is the only one, it doesn't count. So each
    side of the join has one row per author and no author, however busy, multiplies rows.
    """
    risky = scores.filter(F.col("score") >= least).groupBy("author").agg(F.min(F.struct("repo", "pr_number")).alias("first"), F.max(F.struct("repo", "pr_number")).alias("last"))
    own = F.struct("repo", "pr_number")
    return changes.join(risky, "author").filter((F.col("first") != own) | (F.col("last") != own)).drop("first", "last")


def new_changes(open_: DataFrame, *analysed: DataFrame) -> DataFrame:
    """Open changes whose number, as text, none of the analysed sets has."""
    known = None
    for df in analysed:
        part = df.select("repo", F.col("pr_number").cast("string").alias("pr"))
        known = part if known is None else known.union(part)
    return open_.withColumn("pr", F.col("pr_number").cast("string")).join(known.distinct(), ["repo", "pr"], "left_anti").drop("pr")


def closed_changes(open_: DataFrame, analysed: DataFrame) -> DataFrame:
    """Analysed changes that are no longer open."""
    return analysed.select("repo", F.col("pr_number").cast("string").alias("pr")).distinct().join(open_.select("repo", F.col("pr_number").cast("string").alias("pr")), ["repo", "pr"], "left_anti")


def verify_fix(original: DataFrame, candidate: DataFrame) -> DataFrame:
    """Findings (rule_id, path, severity, message) of both versions with status ``resolved`` or ``remaining``.

    Original findings are distinct by signature; resolved ones lack it in the candidate; all of the candidate remain.
    """
    from ..functions.scoring import finding_signature

    sign = finding_signature(F.col("rule_id"), F.col("path"), F.col("severity"), F.col("message"))
    before = original.withColumn("signature", sign).dropDuplicates(["signature"])
    after = candidate.withColumn("signature", sign)
    gone = before.join(after.select("signature").distinct(), "signature", "left_anti").withColumn("status", F.lit("resolved"))
    return gone.unionByName(after.withColumn("status", F.lit("remaining")))


def tokens_by_org(usage: DataFrame) -> DataFrame:
    return usage.groupBy("org_id", "month").agg(F.sum("tokens_used").alias("tokens_used"))


def validation_summary(cases: DataFrame) -> DataFrame:
    """(class, difficulty, n, ok, percent): agreement with the expected verdicts, percent rounded down."""
    return cases.groupBy("class", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.count_if("agrees").alias("ok")).withColumn("percent", F.floor(100 * F.col("ok") / F.col("n")))


def consecutive_errors(polls: DataFrame, least: int = 5) -> DataFrame:
    """(repo, errors, status): failed polls since the last success; ``error`` from ``least`` on. ``polls``: (repo, ts, ok)."""
    last_ok = polls.groupBy("repo").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("since"))
    n = polls.join(last_ok, "repo").groupBy("repo").agg(F.count_if(~F.col("ok") & (F.col("since").isNull() | (F.col("ts") > F.col("since")))).alias("errors"))
    return n.withColumn("status", F.when(F.col("errors") >= least, "error").otherwise("ok"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in a total ``order``, without bringing them into one partition.

    Rows are dealt to ranges of the order and numbered within each; the sizes of the ranges before are added. ``order`` should
    have no ties.
    """
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").count().orderBy("_range").collect()  # a row for each partition
    before, total = {}, 0
    for r in sizes:
        before[r["_range"]] = total
        total += r["count"]
    offset = literal_map(before)[F.col("_range")] if before else F.lit(0)
    return within.withColumn(name, (F.col("_n") + offset).cast("long")).drop("_range", "_n")
