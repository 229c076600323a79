"""The registered queries of the engine's own operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions import text as X
from ..functions.staging import shared_dir, spread
from ..operators import history as H
from ..operators import maintenance as M
from ..operators import matching
from ..operators import packing as P
from ..sources import diffs as D
from ..sources import manifests
from ..streaming import jobs
from . import analyze as A
from .fixtures import HUNKS, LAYERED, SCORES, hunks, layered, scores, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LIGHTS = "count(*) FILTER (verdict = 'verde') AS verde, count(*) FILTER (verdict = 'amarillo') AS amarillo, count(*) FILTER (verdict = 'rojo') AS rojo"

# --- history ----------------------------------------------------------------------------------------------------


@query("org_metrics", SCORES + f"""SELECT count(*) AS total, round(avg(score), 1) AS avg_score, {LIGHTS}, count(*) FILTER (human_feedback = 'correcto') AS feedback_correct, count(*) FILTER (human_feedback = 'falso_positivo') AS feedback_fp,
count(*) FILTER (coalesce(human_feedback, '') NOT IN ('correcto', 'falso_positivo')) AS feedback_pending, round(avg(static_score) FILTER (NOT static_skipped), 1) AS avg_static, round(avg(semantic_score) FILTER (semantic_skipped IS NOT TRUE), 1) AS avg_semantic FROM scores""")
def _(spark, d):
    return H.org_metrics(scores(spark, d))


@query("repo_metrics", SCORES + f"SELECT repo, count(*) AS prs, round(avg(score), 1) AS avg_score, {LIGHTS}, count(*) FILTER (human_feedback IS NULL) AS feedback_pending FROM scores GROUP BY repo")
def _(spark, d):
    return H.repo_metrics(scores(spark, d))


@query("daily_trend", SCORES + "SELECT day, round(avg(score), 1) AS avg_score, count(*) AS prs FROM scores GROUP BY day")
def _(spark, d):
    return H.daily_trend(scores(spark, d))


@query("author_breakdown", SCORES + f"SELECT author, count(*) AS prs, CAST(round(avg(score), 0) AS INT) AS avg_score, {LIGHTS}, arg_max(verdict, (ts, pr_number)) AS latest FROM scores GROUP BY author")
def _(spark, d):
    return H.author_breakdown(scores(spark, d))


@query("nature_by_day", SCORES + "SELECT day, count(*) FILTER (nature = 'malicioso') AS malicioso, count(*) FILTER (nature = 'vulnerabilidad') AS vulnerabilidad, count(*) FILTER (nature = 'incertidumbre') AS incertidumbre FROM scores GROUP BY day")
def _(spark, d):
    return H.nature_by_day(scores(spark, d))


@query("summary_cards", SCORES + "SELECT count(*) AS prs, round(avg(score), 1) AS avg_score, count(*) FILTER (verdict = 'rojo') AS red, count(*) FILTER (human_feedback IS NULL) AS pending FROM scores")
def _(spark, d):
    return H.summary_cards(scores(spark, d))


@query("repo_list", SCORES + "SELECT repo, count(*) AS prs, CAST(round(avg(score), 0) AS INT) AS avg_score, arg_max(verdict, (ts, pr_number)) AS latest, count(*) FILTER (verdict = 'rojo') AS red, count(*) FILTER (verdict = 'amarillo') AS yellow, count(*) FILTER (human_feedback IS NULL) AS pending FROM scores GROUP BY repo")
def _(spark, d):
    return H.repo_list(scores(spark, d))


@query("repo_list_by_risk", SCORES + "SELECT repo, latest, row_number() OVER (ORDER BY CASE latest WHEN 'rojo' THEN 0 WHEN 'amarillo' THEN 1 WHEN 'verde' THEN 2 ELSE 3 END, repo) AS place FROM (SELECT repo, arg_max(verdict, (ts, pr_number)) AS latest FROM scores GROUP BY repo)")
def _(spark, d):
    listed = H.repo_list(scores(spark, d)).select("repo", "latest").withColumn("risk", H.risk_order(F.col("latest")))
    return H.numbered(listed, "risk", "repo").drop("risk")


@query("score_history", SCORES + "SELECT repo, pr_number, ts, score FROM scores WHERE repo = 'org/repo3' ORDER BY ts DESC, pr_number DESC LIMIT 50")
def _(spark, d):
    return H.score_history(scores(spark, d), "org/repo3", 50).select("repo", "pr_number", "ts", "score")


@query("agent_metrics", SCORES + """, a AS (SELECT agent, count(*) AS prs, round(avg(score), 1) AS avg_score FROM (SELECT CASE WHEN event_id % 3 = 0 THEN author WHEN event_id % 3 = 1 THEN '' END AS agent, score FROM scores) WHERE coalesce(agent, '') <> '' GROUP BY agent),
t AS (SELECT 'u' || (user_id + 5) AS agent, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY 1)
SELECT agent, coalesce(prs, 0) AS prs, coalesce(avg_score, 0) AS avg_score, coalesce(tokens, 0) AS tokens FROM a FULL JOIN t USING (agent)""")
def _(spark, d):
    agent = F.when(F.col("event_id") % 3 == 0, F.col("author")).when(F.col("event_id") % 3 == 1, F.lit(""))
    usage = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") + 5).alias("user_id"), (F.col("event_id") % 100).alias("tokens_used"))
    return H.agent_metrics(scores(spark, d).select(agent.alias("agent"), "score"), usage)


@query("prior_risk_authors", SCORES + "SELECT repo, pr_number, author, event_id FROM scores a WHERE score < 10 AND EXISTS (SELECT 1 FROM scores b WHERE b.author = a.author AND b.score >= 99 AND NOT (b.repo = a.repo AND b.pr_number = a.pr_number))")
def _(spark, d):
    s = scores(spark, d)
    return H.authors_with_prior_risk(s.filter("score < 10").select("repo", "pr_number", "author", "event_id"), s, 99)


@query("prior_risk_authors_full", SCORES + f"SELECT repo, pr_number, author, event_id FROM scores a WHERE EXISTS (SELECT 1 FROM scores b WHERE b.author = a.author AND b.score >= {K.RED} AND NOT (b.repo = a.repo AND b.pr_number = a.pr_number))")
def _(spark, d):
    s = scores(spark, d)
    return H.authors_with_prior_risk(s.select("repo", "pr_number", "author", "event_id"), s)


_OPEN = "o AS (SELECT 'org/repo' || (o_custkey % 7) AS repo, o_orderkey % 700 AS pr_number FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)"


def _open_changes(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.concat(F.lit("org/repo"), F.col("o_custkey") % 7).alias("repo"), (F.col("o_orderkey") % 700).alias("pr_number")).distinct()


@query("new_changes", SCORES + f", {_OPEN} SELECT repo, pr_number FROM o WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.repo = o.repo AND s.pr_number = o.pr_number)")
def _(spark, d):
    s = scores(spark, d)
    return H.new_changes(_open_changes(spark, d), s.filter("score < 50"), s.filter("score >= 50")).select("repo", "pr_number")


@query("closed_changes", SCORES + f", {_OPEN} SELECT DISTINCT repo, CAST(pr_number AS VARCHAR) AS pr FROM scores s WHERE NOT EXISTS (SELECT 1 FROM o WHERE s.repo = o.repo AND s.pr_number = o.pr_number)")
def _(spark, d):
    return H.closed_changes(_open_changes(spark, d), scores(spark, d))


def _findings(spark, d, file="l_partkey % 50"):
    return table(spark, d, "lineitem").select(F.concat(F.lit("rule"), F.col("l_suppkey") % 9).alias("rule_id"), F.concat(F.lit("f"), F.expr(file)).alias("path"), F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("message"), "l_orderkey", "l_linenumber")


@query("verify_fix", """WITH f AS (SELECT 'rule' || (l_suppkey % 9) AS rule_id, 'f' || (l_partkey % 50) AS path, l_returnflag AS severity, l_linestatus AS message, l_orderkey FROM lineitem),
a AS (SELECT DISTINCT rule_id, path, severity, message FROM f WHERE l_orderkey % 2 = 0), b AS (SELECT rule_id, path, severity, message FROM f WHERE l_orderkey % 11 = 1)
SELECT *, 'resolved' AS status, sha256(concat_ws(':', rule_id, path, severity, message)) AS signature FROM a WHERE (rule_id, path, severity, message) NOT IN (SELECT (rule_id, path, severity, message) FROM b) UNION ALL SELECT *, 'remaining', sha256(concat_ws(':', rule_id, path, severity, message)) FROM b""")
def _(spark, d):
    f = _findings(spark, d)
    part = lambda c: f.filter(c).select("rule_id", "path", "severity", "message")
    return H.verify_fix(part("l_orderkey % 2 = 0"), part("l_orderkey % 11 = 1"))


@query("verify_fix_full", """WITH f AS (SELECT 'rule' || (l_suppkey % 9) AS rule_id, 'f' || l_partkey AS path, l_returnflag AS severity, l_linestatus AS message, l_orderkey FROM lineitem),
a AS (SELECT DISTINCT rule_id, path, severity, message FROM f WHERE l_orderkey % 2 = 0), b AS (SELECT rule_id, path, severity, message FROM f WHERE l_orderkey % 2 = 1)
SELECT *, 'resolved' AS status, sha256(concat_ws(':', rule_id, path, severity, message)) AS signature FROM a WHERE (rule_id, path, severity, message) NOT IN (SELECT (rule_id, path, severity, message) FROM b) UNION ALL SELECT *, 'remaining', sha256(concat_ws(':', rule_id, path, severity, message)) FROM b""")
def _(spark, d):
    f = _findings(spark, d, "l_partkey")
    part = lambda c: f.filter(c).select("rule_id", "path", "severity", "message")
    return H.verify_fix(part("l_orderkey % 2 = 0"), part("l_orderkey % 2 = 1"))


@query("tokens_by_org", "SELECT 'org' || (user_id % 4) AS org_id, strftime(ts, '%Y-%m') AS month, CAST(sum(event_id % 97) AS BIGINT) AS tokens_used FROM events GROUP BY ALL")
def _(spark, d):
    return H.tokens_by_org(table(spark, d, "events").select(F.concat(F.lit("org"), F.col("user_id") % 4).alias("org_id"), F.date_format("ts", "yyyy-MM").alias("month"), (F.col("event_id") % 97).alias("tokens_used")))


@query("latest_per_repo", SCORES + "SELECT repo, pr_number, max((ts, event_id))[2] AS event_id FROM scores GROUP BY repo, pr_number".replace("max((ts, event_id))[2]", "arg_max(event_id, ts)"))
def _(spark, d):
    return M.latest(scores(spark, d), ["repo", "pr_number"], ["ts", "event_id"]).select("repo", "pr_number", "event_id")


@query("consecutive_errors", """WITH p AS (SELECT 'r' || (user_id % 40) AS repo, ts, event_id % 7 = 0 AS ok FROM events), s AS (SELECT repo, max(ts) FILTER (ok) AS since FROM p GROUP BY repo)
SELECT repo, count(*) FILTER (NOT ok AND (since IS NULL OR ts > since)) AS errors, CASE WHEN count(*) FILTER (NOT ok AND (since IS NULL OR ts > since)) >= 5 THEN 'error' ELSE 'ok' END AS status FROM p JOIN s USING (repo) GROUP BY repo""")
def _(spark, d):
    return H.consecutive_errors(table(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 40).alias("repo"), "ts", (F.col("event_id") % 7 == 0).alias("ok")))


@query("validation_summary", "SELECT o_orderpriority AS class, o_orderstatus AS difficulty, count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS ok, CAST(floor(100 * count(*) FILTER (o_orderkey % 5 <> 0) / count(*)) AS BIGINT) AS percent FROM orders GROUP BY ALL")
def _(spark, d):
    return H.validation_summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("difficulty"), (F.col("o_orderkey") % 5 != 0).alias("agrees")))


# --- maintenance ------------------------------------------------------------------------------------------------


@query("retention_purge", SCORES + "SELECT repo, count(*) AS n, min(ts) AS oldest FROM scores WHERE ts >= '2024-01-11' GROUP BY repo")
def _(spark, d):
    return M.purge(scores(spark, d), "2024-01-11").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


@query("repo_cascade", SCORES + "SELECT 'scores' AS t, repo, count(*) AS n FROM scores WHERE repo <> 'org/repo2' GROUP BY repo UNION ALL SELECT 'open', repo, count(*) FROM scores WHERE repo <> 'org/repo2' AND state = 'open' GROUP BY repo")
def _(spark, d):
    s = scores(spark, d)
    left = M.cascade("org/repo2", scores=s, open=s.filter("state = 'open'"))
    parts = [t.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "repo", "n") for n, t in left.items()]
    return parts[0].unionByName(parts[1])


@query("close_changes", SCORES + ", c AS (SELECT DISTINCT repo, pr_number FROM scores WHERE event_id % 10 = 0 AND pr_number <> 0) SELECT event_id, CASE WHEN state = 'open' AND (repo, pr_number) IN (SELECT (repo, pr_number) FROM c) THEN 'closed' ELSE state END AS state FROM scores")
def _(spark, d):
    s = scores(spark, d)
    return M.close_changes(s, s.filter("event_id % 10 = 0")).select("event_id", "state")


@query("add_usage", "WITH u AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, CASE WHEN event_id % 2 = 0 AND event_id < 3000 THEN 'a' WHEN event_id >= 3000 THEN 'b' END AS org_id, event_id % 50 AS t FROM events) SELECT user_id, month, min(org_id) AS org_id, CAST(sum(t) AS BIGINT) AS tokens_used FROM u GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY user_id, month"))
def _(spark, d):
    e = table(spark, d, "events")
    part = lambda c, org: e.filter(c).select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), org.alias("org_id"), (F.col("event_id") % 50).alias("tokens_used"))
    old = part("event_id < 3000", F.when(F.col("event_id") % 2 == 0, "a"))
    return M.add_usage(old, part("event_id >= 3000", F.lit("b")))


@query("insert_unseen_rules", "SELECT min(p_partkey) AS p_partkey, p_name FROM part WHERE p_partkey % 2 = 1 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0 AND p_size < 3) GROUP BY p_name")
def _(spark, d):
    p = table(spark, d, "part")
    return M.insert_unseen(p.filter("p_partkey % 2 = 0 AND p_size < 3"), p.filter("p_partkey % 2 = 1").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("insert_unseen_rules_full", "WITH p AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_size) AS p_name FROM part) SELECT min(p_partkey) AS p_partkey, p_name FROM p WHERE p_partkey % 2 = 1 AND p_name NOT IN (SELECT p_name FROM p WHERE p_partkey % 2 = 0) GROUP BY p_name")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("p_name"))
    return M.insert_unseen(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"), "p_name", "p_partkey")


@query("effective_settings", "SELECT CAST(c_custkey AS VARCHAR) AS repo, 'n' || c_nationkey AS org, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 50 END, CASE WHEN c_nationkey % 2 = 0 THEN 60 END, 70) AS red, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 20 END, 40) AS yellow FROM customer")
def _(spark, d):
    repos = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("repo"), F.concat(F.lit("n"), "c_nationkey").alias("org"), "c_custkey")
    own = repos.filter("c_custkey % 3 = 0").select("repo", F.lit(50).alias("red"), F.lit(20).alias("yellow"))
    orgs = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("org"), F.lit(60).alias("red"), F.lit(None).cast("int").alias("yellow"))
    return M.effective_settings(repos.select("repo", "org"), own, orgs, {"red": 70, "yellow": 40})


@query("visible_repos", "SELECT DISTINCT repo FROM (SELECT 'c' || c_custkey AS repo FROM customer WHERE c_custkey % 100 = 7 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 100 = 7 AND c_nationkey < 9))")
def _(spark, d):
    roles = table(spark, d, "customer").select((F.col("c_custkey") % 100).cast("string").alias("user_id"), F.concat(F.lit("c"), "c_custkey").alias("repo"), F.when(F.col("c_nationkey") < 9, F.col("c_nationkey")).alias("org"))
    monitored = table(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), F.concat(F.lit("s"), "s_suppkey").alias("repo"))
    return M.visible_repos(roles, monitored, "7")


@query("fresh_cache", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOURS")
def _(spark, d):
    return M.fresh(table(spark, d, "events").withColumn("fetched_at", F.col("ts").cast("timestamp")), "2024-01-20 12:00:00").select("event_id")


# --- scoring ----------------------------------------------------------------------------------------------------


def _layers():
    return {n: F.col(n) for n in K.LAYERS}


_ON = {n: f"(CASE WHEN NOT {n}_skipped THEN {w} ELSE 0 END)" for n, w in K.WEIGHTS.items()}
_TOP, _BELOW = " + ".join(f"{_ON[n]} * {n}_score" for n in K.LAYERS), " + ".join(_ON.values())
_HEARD = "NOT semantic_skipped"
FINAL = f"""s1 AS (SELECT *, CASE WHEN {_BELOW} > 0 THEN CAST(round_even(CAST(({_TOP}) AS DOUBLE) / ({_BELOW}), 0) AS INT) ELSE 0 END AS mean FROM layered),
s2 AS (SELECT *, CASE WHEN ({_HEARD} AND semantic_confidence = 'alta' AND semantic_category IN ('BACKDOOR', 'OFUSCACION') AND semantic_score >= 85) OR ({_HEARD} AND semantic_nature = 'malicioso' AND semantic_confidence IN ('alta', 'media')) THEN greatest(mean, 70) ELSE mean END AS up FROM s1),
final AS (SELECT *, CASE WHEN up < 40 AND (({_HEARD} AND semantic_confidence = 'alta' AND semantic_score >= 70) OR ({_HEARD} AND semantic_nature = 'incertidumbre' AND semantic_score >= 40)) THEN 40 ELSE up END AS score FROM s2)
"""


@query("final_score", LAYERED + f", {FINAL} SELECT id, score, CASE WHEN score >= 70 THEN 'rojo' WHEN score >= 40 THEN 'amarillo' ELSE 'verde' END AS verdict, CASE WHEN score >= 70 THEN 'BLOCK_HUMAN_REVIEW' WHEN score >= 40 THEN 'RETRY_WITH_FIX' ELSE 'PROCEED' END AS action FROM final")
def _(spark, d):
    score = S.final_score(_layers())
    rows = layered(spark, d).select("id", score.alias("score"))
    return rows.withColumn("verdict", S.verdict(F.col("score"))).withColumn("action", S.guidance(F.col("verdict")))


@query("effective_weights", LAYERED + "SELECT id, " + ", ".join(f"CASE WHEN {_BELOW} > 0 THEN round({_ON[n]} / CAST(({_BELOW}) AS DOUBLE), 4) ELSE 0 END AS {n}" for n in K.LAYERS) + " FROM layered")
def _(spark, d):
    rows = layered(spark, d).select("id", S.effective_weights(_layers()).alias("w"))
    return rows.select("id", *(F.element_at("w", F.lit(n)).alias(n) for n in K.LAYERS))


_PART = [n for n in K.LAYERS if n != "semantic"]
_PTOP, _PBELOW = " + ".join(f"{_ON[n]} * {n}_score" for n in _PART), " + ".join(_ON[n] for n in _PART)


@query("short_circuit", LAYERED + f"""SELECT id, CASE WHEN {' OR '.join(f"(NOT {n}_skipped AND coalesce({n}_nature = 'malicioso' AND {n}_confidence = 'alta', false))" for n in _PART)} THEN 'rojo'
WHEN round_even(CAST(({_PTOP}) AS DOUBLE) / ({_PBELOW} + 0.4), 0) >= 70 THEN 'rojo' WHEN (CASE WHEN {_PBELOW} > 0 THEN CAST(({_PTOP}) AS DOUBLE) / ({_PBELOW}) ELSE 0 END) < 20 AND id % 3 <> 0 AND NOT ({' OR '.join(f'{n}_crashed' for n in _PART)}) AND id % 20 <> 1 THEN 'verde' END AS light FROM layered""")
def _(spark, d):
    return layered(spark, d).select("id", S.short_circuit(_layers(), F.col("id") % 3 == 0, F.col("id") % 20 == 1).alias("light"))


@query("reputation_score", """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 120 END AS age, c_custkey % 3 AS repos, c_custkey % 4 AS followers, c_custkey % 5 AS prior, c_custkey % 2 = 0 AS email, c_custkey % 3 = 0 AS signs, c_custkey % 5 < 3 AS signed, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 4 = 0 END AS seen, c_custkey % 41 = 0 AS risky FROM customer)
SELECT id, CASE WHEN risky THEN 100 ELSE least(100, (CASE WHEN age < 30 THEN 10 ELSE 0 END) + (CASE WHEN repos = 0 AND followers = 0 AND age < 90 THEN 15 ELSE 0 END) + (CASE WHEN prior = 0 THEN 20 ELSE 0 END) + (CASE WHEN NOT email THEN 25 ELSE 0 END) + (CASE WHEN signs AND NOT signed THEN 30 ELSE 0 END) + (CASE WHEN signed AND seen IS FALSE THEN 40 ELSE 0 END)) END AS score FROM r""")
def _(spark, d):
    k = F.col("c_custkey")
    r = {"account_age_days": F.when(k % 7 != 0, k % 120), "public_repos": k % 3, "followers": k % 4, "prior_contributions": k % 5, "email_verified": k % 2 == 0, "repo_signs": k % 3 == 0, "commit_signed": k % 5 < 3, "key_seen": F.when(k % 4 < 2, k % 4 == 0), "prior_high_risk": k % 41 == 0}
    return table(spark, d, "customer").select(k.alias("id"), S.reputation_score(r).alias("score"))


_AXES = {"AV": "NALPX", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "NLH", "I": "NLH", "A": "NLH"}


def _case(key: str, table_: dict) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table_.items()) + " END)"


def _axis_sql() -> str:
    out, step = [], 1
    for k, letters in _AXES.items():
        out.append(f"substr('{letters}', CAST((o_orderkey // {step}) % {len(letters)} AS INT) + 1, 1) AS {k}")
        step *= len(letters)
    return ", ".join(out)


@query("cvss3_score", f"""WITH v AS (SELECT o_orderkey AS id, {_axis_sql()} FROM orders),
w AS (SELECT *, 8.22::DOUBLE * {_case('AV', K.CVSS_AV)} * {_case('AC', K.CVSS_AC)} * (CASE WHEN S = 'C' THEN {_case('PR', K.CVSS_PR_CHANGED)} ELSE {_case('PR', K.CVSS_PR_UNCHANGED)} END) * {_case('UI', K.CVSS_UI)} AS easy,
 1 - ((1 - {_case('C', K.CVSS_CIA)}) * (1 - {_case('I', K.CVSS_CIA)}) * (1 - {_case('A', K.CVSS_CIA)})) AS iss FROM v),
x AS (SELECT *, CASE WHEN S = 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * power(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact FROM w),
y AS (SELECT *, CAST(round_even(least((impact + easy) * (CASE WHEN S = 'C' THEN 1.08::DOUBLE ELSE 1 END), 10) * 100000, 0) AS BIGINT) AS n FROM x)
SELECT id, CASE WHEN easy IS NULL THEN NULL WHEN iss <= 0 OR impact <= 0 THEN 0 WHEN n % 10000 = 0 THEN n / 100000.0::DOUBLE ELSE (n // 10000 + 1) / 10.0::DOUBLE END AS score FROM y""")
def _(spark, d):
    parts, step = [], 1
    for k, letters in _AXES.items():
        parts.append(F.concat(F.lit(f"/{k}:"), F.substr(F.lit(letters), (F.floor(F.col("o_orderkey") / step) % len(letters)).cast("int") + 1, F.lit(1))))
        step *= len(letters)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.cvss3(F.concat(F.lit("CVSS:3.1"), *parts)).alias("score"))


@query("confidence_and_nature", LAYERED + """SELECT id, CASE WHEN static_score >= 70 THEN 'alta' WHEN static_score >= 40 THEN 'media' WHEN static_score > 0 THEN 'baja' END AS confidence, CASE WHEN id % 5 > 3 THEN 'malicioso' WHEN id % 3 > 1 THEN 'vulnerabilidad' WHEN id % 2 > 0 THEN 'incertidumbre' END AS nature,
abs(static_score - 40) <= 10 OR abs(static_score - 70) <= 10 AS borderline, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 0 ELSE 5000 - id END AS budget FROM layered""")
def _(spark, d):
    i, s = F.col("id"), F.col("static.score")
    limit = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, F.lit(-1)).otherwise(5000).cast("long")
    return layered(spark, d).select("id", S.confidence_of(s).alias("confidence"), S.dominant_nature(F.when(i % 5 > 3, 1).otherwise(0), F.when(i % 3 > 1, 1).otherwise(0), i % 2).alias("nature"), S.borderline(s).alias("borderline"), S.budget_left(limit, i).alias("budget"))


@query("threat_summary", SCORES + "SELECT repo, pr_number, count(*) FILTER (nature = 'malicioso') AS malicioso, count(*) FILTER (nature = 'vulnerabilidad') AS vulnerabilidad, count(*) FILTER (nature = 'incertidumbre') AS incertidumbre FROM scores WHERE NOT static_skipped GROUP BY ALL")
def _(spark, d):
    return scores(spark, d).filter("NOT static_skipped").groupBy("repo", "pr_number").agg(*(F.count_if(F.col("nature") == n).alias(n) for n in (K.MALICIOUS, K.VULNERABILITY, K.UNCERTAIN)))


@query("semantic_floors", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 60 ELSE 30 END AS unread, CASE WHEN doc_id % 4 IN (1, 2) THEN 100 ELSE 30 END AS steered FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    paths = F.when(i % 3 < 2, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    fetched = F.when(i % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    labels = F.element_at(F.array(F.array(F.lit("role_override")), F.array(F.lit("new_instructions_marker")), F.array(F.lit("role_override"), F.lit("embedded_fake_json_response")), F.array(F.lit("fake_role_marker"))), (i % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", S.unverified_floor(F.lit(30), paths, fetched).alias("unread"), S.injection_floor(F.lit(30), labels).alias("steered"))


@query("rule_nature", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'incertidumbre' WHEN 1 THEN 'malicioso' WHEN 2 THEN 'vulnerabilidad' WHEN 3 THEN 'malicioso' ELSE 'vulnerabilidad' END AS nature FROM part")
def _(spark, d):
    i = F.col("p_partkey")
    text = lambda n, v: F.when(i % 5 == n, v)
    return table(spark, d, "part").select(i.alias("id"), S.rule_nature(text(0, "incertidumbre"), text(3, "Web Backdoor"), F.lit(None).cast("string"), F.coalesce(text(1, "Malicious"), text(2, "vulnerability")), F.concat(F.lit("rule."), F.col("p_brand"))).alias("nature"))


# --- text -------------------------------------------------------------------------------------------------------

_HUNK_LINES = "l AS (SELECT doc_id, source, path, extra, list_concat(body, ['+' || extra]) AS body FROM hunks)"


@query("hunk_line_counts", HUNKS + f", {_HUNK_LINES} SELECT doc_id, len(list_filter(body, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS additions, len(list_filter(body, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS deletions FROM l")
def _(spark, d):
    a, b = X.line_counts(F.col("diff_hunk"))
    return hunks(spark, d).select("doc_id", a.alias("additions"), b.alias("deletions"))


@query("hunk_new_content", HUNKS + f", {_HUNK_LINES} SELECT doc_id, md5(array_to_string(list_transform(list_filter(body, lambda x: x[1] IN ('+', ' ') AND NOT starts_with(x, '+++ ')), lambda x: substr(x, 2)), chr(10))) AS content FROM l")
def _(spark, d):
    return hunks(spark, d).select("doc_id", F.md5(X.new_content(F.col("diff_hunk"))).alias("content"))


@query("added_lines", HUNKS + f", {_HUNK_LINES} SELECT doc_id, i + 3 AS line, md5(substr(x, 2)) AS text FROM (SELECT doc_id, unnest(body) AS x, generate_subscripts(body, 1) AS i FROM l) WHERE starts_with(x, '+') AND NOT starts_with(x, '++')")
def _(spark, d):
    return hunks(spark, d).select("doc_id", F.explode(X.added_lines(F.col("diff_hunk"))).alias("a")).select("doc_id", "a.line", F.md5("a.text").alias("text"))


_LABELS = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{label}' AS label FROM hunks WHERE regexp_matches(extra, '(?i){p}')" for i, (p, label) in enumerate(K.SUSPICIOUS))


@query("suspicious_scan", HUNKS + f"SELECT doc_id, label FROM ({_LABELS})")
def _(spark, d):
    return hunks(spark, d).select("doc_id", F.explode(X.suspicious_labels(F.col("extra"))).alias("label"))


_INJ = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM hunks WHERE regexp_matches(extra, '{p.replace(chr(39), chr(39) * 2)}')" for p, label in K.INJECTION if p)


@query("injection_scan", HUNKS + f"SELECT doc_id, label FROM ({_INJ})")
def _(spark, d):
    return hunks(spark, d).select("doc_id", F.explode(X.injection_labels(F.col("extra"))).alias("label"))


@query("conversation_roles", "SELECT conv_id, count(DISTINCT role) >= 2 AS pretended FROM conversations WHERE role IN ('system', 'assistant', 'user') GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role").isin("system", "assistant", "user"))
    text = c.groupBy("conv_id").agg(F.array_join(F.collect_set(F.concat("role", F.lit(": x"))), "\n").alias("t"))
    return text.select("conv_id", (F.size(X.roles(F.col("t"))) >= 2).alias("pretended"))


_LITERALS = "lit AS (SELECT DISTINCT doc_id, source, unnest(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in K.NOTABLE_LITERALS) + ")) AS literal FROM documents)"


@query("notable_literals", f"WITH {_LITERALS} SELECT doc_id, literal FROM lit")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.notable_literals(F.col("text"))).alias("literal"))


@query("shared_literal_edges", f"WITH {_LITERALS} SELECT DISTINCT 1 AS diff_id, x.doc_id AS a, y.doc_id AS b FROM lit x JOIN lit y ON x.literal = y.literal AND x.doc_id < y.doc_id")
def _(spark, d):
    lit = table(spark, d, "documents").select(F.lit(1).alias("diff_id"), "doc_id", F.explode(X.notable_literals(F.col("text"))).alias("literal"))
    return matching.shared_literal_edges(lit, "diff_id", "doc_id")


_PATHS = "WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'lib/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN '' ELSE '../C:/a/./' END || p_name || ([" + ", ".join(f"'{s}'" for s in (".py", ".JS", ".tf", "/Dockerfile", ".min.js", "", "/go.sum", ".yml")) + "])[p_partkey % 8 + 1] AS path, p_size * 9000 AS size FROM part)\n"


def _paths(spark, d):
    k = F.col("p_partkey")
    end = F.element_at(F.array(*(F.lit(s) for s in (".py", ".JS", ".tf", "/Dockerfile", ".min.js", "", "/go.sum", ".yml"))), (k % 8 + 1).cast("int"))
    head = F.when(k % 4 == 0, "lib/").when(k % 4 == 1, "node_modules/x/").when(k % 4 == 2, "").otherwise("../C:/a/./")
    return table(spark, d, "part").select(k.alias("id"), F.concat(head, "p_name", end).alias("path"), (F.col("p_size") * 9000).alias("size"))


def _lookup(key: str, m: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query("path_facts", _PATHS + f""", q AS (SELECT *, string_split(path, '/')[-1] AS name FROM p)
SELECT id, coalesce({_lookup('name', K.LANGUAGE_OF_FILENAME)}, {_lookup("CASE WHEN contains(name, '.') THEN '.' || string_split(name, '.')[-1] END", K.LANGUAGE_OF_EXTENSION)}) AS language,
CASE WHEN lower(name) = 'dockerfile' THEN 'dockerfile' ELSE {_lookup("lower(CASE WHEN contains(name, '.') THEN '.' || string_split(name, '.')[-1] END)", K.RULE_LANGUAGE_OF_EXTENSION)} END AS rule_language,
name IN ({', '.join(f"'{m}'" for m in K.MANIFESTS)}) AS manifest, size <= 200000 AND NOT list_has_any(string_split(path, '/')[:-2], {list(K.EXCLUDED_DIRS)}) AND NOT regexp_matches(lower(path), '({'|'.join(s.replace('.', chr(92) + '.') for s in K.EXCLUDED_SUFFIXES)})$') AS indexed FROM q""")
def _(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("id", X.language(p).alias("language"), X.rule_language(p).alias("rule_language"), X.is_manifest(p).alias("manifest"), X.should_index(p, F.col("size")).alias("indexed"))


@query("sarif_paths", _PATHS + "SELECT id, array_to_string(list_filter(string_split(CASE WHEN contains(path, ':') THEN substr(path, strpos(path, ':') + 1) ELSE path END, '/'), lambda x: x NOT IN ('', '.', '..')), '/') AS path FROM p")
def _(spark, d):
    return _paths(spark, d).select("id", X.sarif_path(F.col("path")).alias("path"))


@query("escaped_and_redacted", "SELECT page_id, replace(replace(replace(replace(url || '%' || chr(10), '%', '%25'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS property, regexp_replace('key sk-' || md5(url) || 'x and ' || url, 'sk-[a-zA-Z0-9_-]{32,}', '[REDACTED_SECRET]', 'g') AS safe FROM pages")
def _(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", X.escape_property(F.concat(url, F.lit("%\n"))).alias("property"), X.redact(F.concat(F.lit("key sk-"), F.md5(url), F.lit("x and "), url)).alias("safe"))


@query("token_estimates", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens, coalesce(TRY_CAST(nullif(regexp_replace(left(text, 40) || doc_id, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS number FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.digits_number(F.concat(F.left("text", F.lit(40)), "doc_id")).alias("number"))


@query("import_edges", """WITH f AS (SELECT p_size AS diff_id, replace(p_name, ' ', '_') || '_' || (p_partkey % 10) || '.py' AS path, replace(p_name, ' ', '_') || '_' || (p_partkey % 10) AS stem, p_brand FROM part GROUP BY ALL),
g AS (SELECT diff_id, path, stem, min(p_brand) AS b FROM f GROUP BY ALL), s AS (SELECT diff_id, path, 'pkg.' || lag(stem) OVER (PARTITION BY diff_id ORDER BY path) || '.x' AS spec FROM g)
SELECT DISTINCT s.diff_id, least(s.path, g.path) AS a, greatest(s.path, g.path) AS b FROM s JOIN g ON s.diff_id = g.diff_id AND contains(s.spec, g.stem) AND s.path <> g.path""")
def _(spark, d):
    from pyspark.sql import Window

    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey") % 10)
    f = table(spark, d, "part").select(F.col("p_size").alias("diff_id"), F.concat(name, F.lit(".py")).alias("path"), name.alias("stem")).distinct()
    content = F.concat(F.lit("import pkg."), F.lag("stem").over(Window.partitionBy("diff_id").orderBy("path")), F.lit(".x\n"))
    files = f.withColumn("imports", F.coalesce(X.import_specifiers(content, F.lit("python")), F.array().cast("array<string>")))
    return matching.import_edges(files.select("diff_id", "path", "imports"))


# --- matching ---------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS name FROM benchmark)"


@query("fuzzy_names", f"WITH {_WORDS} SELECT 'x' AS eco, a.name AS l, b.name AS r, levenshtein(a.name, b.name) AS distance FROM w a JOIN w b ON abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(a.name, b.name) BETWEEN 1 AND 2")
def _(spark, d):
    w = table(spark, d, "benchmark").select(F.lit("x").alias("eco"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("name")).distinct()
    return matching.fuzzy_pairs(w, w, "eco")


_SUF = ", ".join(f"'{s}'" for s in K.COMBOSQUAT_SUFFIXES)


@query("lookalike_packages", f"""WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'pypi' END AS eco, p_name AS ref, min(p_partkey) AS ord FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL),
n AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem, CASE p_partkey % 4 WHEN 0 THEN p_name || 'x' WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN p_name || ([{_SUF}])[p_partkey % 14 + 1] ELSE p_name END AS name FROM part),
d AS (SELECT *, lower(ecosystem) AS eco, replace(lower(name), '_', '-') AS norm FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.eco = lower(n.ecosystem) AND (r.ref = lower(n.name) OR r.ref = replace(lower(n.name), '_', '-')))),
t AS (SELECT ecosystem, name, arg_min(ref, ord) AS t FROM d JOIN r ON d.eco = r.eco AND length(norm) >= 6 AND length(ref) >= 6 AND levenshtein(norm, replace(lower(ref), '_', '-')) BETWEEN 1 AND 2 GROUP BY ALL),
c AS (SELECT ecosystem, name, arg_min(ref, ord) AS c FROM d JOIN (SELECT *, replace(lower(ref), '_', '-') || unnest([{_SUF}]) AS long FROM r) r ON d.eco = r.eco AND norm = long GROUP BY ALL)
SELECT ecosystem, name, coalesce(t, c) AS looks_like FROM d LEFT JOIN t USING (ecosystem, name) LEFT JOIN c USING (ecosystem, name) WHERE coalesce(t, c) IS NOT NULL""")
def _(spark, d):
    return _lookalikes(spark, d, "p_partkey % 3 = 0")


@query("lookalike_packages_full", SQL["lookalike_packages"].replace(" WHERE p_partkey % 3 = 0", ""))
def _(spark, d):
    return _lookalikes(spark, d, "true")


def _lookalikes(spark, d, listed):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    even = F.col("p_size") % 2 == 0
    refs = p.filter(listed).groupBy(F.when(even, "npm").otherwise("pypi").alias("ecosystem"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    suffix = F.element_at(F.array(*(F.lit(s) for s in K.COMBOSQUAT_SUFFIXES)), (k % 14 + 1).cast("int"))
    name = F.when(k % 4 == 0, F.concat("p_name", F.lit("x"))).when(k % 4 == 1, F.substr("p_name", F.lit(2))).when(k % 4 == 2, F.concat("p_name", suffix)).otherwise(F.col("p_name"))
    return matching.lookalikes(p.select(F.when(even, "npm").otherwise("PyPI").alias("ecosystem"), name.alias("name")), refs)


_DOT = "list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NORM = lambda t: f"sqrt(list_sum(list_transform({t}.embedding, lambda z: z::DOUBLE * z::DOUBLE)))"
_RANKED = f"r AS (SELECT q.vec_id AS query, i.vec_id AS id, i.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - {_DOT} / ({_NORM('q')} * {_NORM('i')}), i.vec_id) AS rank FROM embeddings i, (SELECT * FROM embeddings WHERE vec_id IN (0, 7, 33)) q)"


_THREE, _HUNDREDTH = "vec_id IN (0, 7, 33)", "vec_id % 100 = 0"
_RANKED_FULL = _RANKED.replace(_THREE, _HUNDREDTH)


def _ranked(spark, d, k, which=_THREE):
    e = table(spark, d, "embeddings")
    return matching.top_k(e.filter(which), e, k, keep=["label"])


@query("vector_top_k", f"WITH {_RANKED} SELECT query, id, rank FROM r WHERE rank <= 10")
def _(spark, d):
    return _ranked(spark, d, 10).select("query", "id", "rank")


@query("vector_top_k_full", SQL["vector_top_k"].replace(_RANKED, _RANKED_FULL))
def _(spark, d):
    return _ranked(spark, d, 10, _HUNDREDTH).select("query", "id", "rank")


_DIV = "v AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY rank) AS n FROM r WHERE rank <= 15) WHERE n = 1))"


@query("vector_diversified", f"WITH {_RANKED}, {_DIV} SELECT query, id, label, place FROM v WHERE place <= 5")
def _(spark, d):
    return matching.diversified_top_k(_ranked(spark, d, 15), 5, "label").select("query", "id", "label", "place")


@query("vector_diversified_full", SQL["vector_diversified"].replace(_RANKED, _RANKED_FULL))
def _(spark, d):
    return matching.diversified_top_k(_ranked(spark, d, 15, _HUNDREDTH), 5, "label").select("query", "id", "label", "place")


@query("vector_reserved_slot", f"WITH {_RANKED} SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s, rank) AS place FROM (SELECT query, id, rank, 0 AS s FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM r WHERE label = 3) WHERE n <= 1 UNION ALL SELECT query, id, rank, 1 FROM r WHERE rank <= 4) QUALIFY place <= 5")
def _(spark, d):
    e = table(spark, d, "embeddings")
    fb = matching.top_k(e.filter("vec_id IN (0, 7, 33)"), e.filter("label = 3"), 1)
    return matching.with_reserved(fb, _ranked(spark, d, 4), 1, 5).select("query", "id", "place")


@query("vector_reserved_slot_full", SQL["vector_reserved_slot"].replace(_RANKED, _RANKED_FULL))
def _(spark, d):
    e = table(spark, d, "embeddings")
    fb = matching.top_k(e.filter(_HUNDREDTH), e.filter("label = 3"), 1)
    return matching.with_reserved(fb, _ranked(spark, d, 4, _HUNDREDTH), 1, 5).select("query", "id", "place")


@query("rule_hits", "SELECT doc_id, 'license' AS rule_id, 60 AS score FROM documents WHERE regexp_matches(text, '(?i)license') UNION ALL SELECT doc_id, 'address', 30 FROM documents WHERE regexp_matches(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')")
def _(spark, d):
    from ..sources.corpus import rules_from_catalog

    rules = rules_from_catalog(spark, [{"id": "license", "pattern": "(?i)license"}, {"id": "address", "pattern": r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "risk_score": 30}])
    return matching.rule_hits(table(spark, d, "documents").select("doc_id", "text"), rules, ["doc_id"], "text").select("doc_id", "rule_id", "score")


# --- packing and repositories -----------------------------------------------------------------------------------


@query("excerpt_windows", """WITH m AS (SELECT o_custkey AS g, o_orderkey % 400 AS line FROM orders GROUP BY ALL), w AS (SELECT g, line, greatest(0, line - 3) AS a, least(400, line + 4) AS z FROM m),
x AS (SELECT *, coalesce(a > max(z) OVER (PARTITION BY g ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM w), y AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY line) AS isl FROM x),
i AS (SELECT g, isl, min(a) AS a, max(z) AS z FROM y GROUP BY ALL), u AS (SELECT *, coalesce(sum(z - a) OVER (PARTITION BY g ORDER BY isl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM i)
SELECT g, a AS start, z AS end FROM u WHERE used < 60""")
def _(spark, d):
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 400).alias("line")).distinct().withColumn("n_lines", F.lit(400).cast("long"))
    return P.excerpt_windows(m, ["g"])


def _repo_files(spark, d):
    return _paths(spark, d).withColumn("repo", F.col("id") % 5).withColumn("ord", F.col("id"))


@query("files_to_index", _PATHS + f""", q AS (SELECT *, id % 5 AS repo, string_split(path, '/')[-1] AS name, length(path) - length(replace(path, '/', '')) AS depth FROM p), l AS (SELECT *, coalesce({_lookup('name', K.LANGUAGE_OF_FILENAME)}, {_lookup("CASE WHEN contains(name, '.') THEN '.' || string_split(name, '.')[-1] END", K.LANGUAGE_OF_EXTENSION)}, 'markdown') IN ('markdown', 'yaml', 'json', 'toml') AS doc FROM q
WHERE size <= 200000 AND NOT contains(path, 'node_modules/') AND NOT regexp_matches(path, '[.]min[.]js$'))
SELECT * FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY doc, depth, path) AS n FROM l) WHERE n <= 40""".replace("SELECT * FROM (SELECT repo, path, row", "SELECT repo, n, path FROM (SELECT repo, path, row"))
def _(spark, d):
    return P.files_to_index(_repo_files(spark, d), most=40).select("repo", "n", "path")


@query("truncation_order", "SELECT o_custkey AS diff_id, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 <> 0, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def _(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "added").when(F.col("o_orderstatus") == "F", "modified").otherwise("deleted")
    return P.truncation_order(table(spark, d, "orders").select(F.col("o_custkey").alias("diff_id"), F.col("o_orderkey").alias("ord"), s.alias("status"), (F.col("o_orderkey") % 5 == 0).alias("flagged"))).select("diff_id", "ord", "place")


@query("project_summary", _PATHS + f""", q AS (SELECT *, id % 5 AS repo, string_split(path, '/')[-1] AS name FROM p), l AS (SELECT repo, id, coalesce({_lookup('name', K.LANGUAGE_OF_FILENAME)}, {_lookup("CASE WHEN contains(name, '.') THEN '.' || string_split(name, '.')[-1] END", K.LANGUAGE_OF_EXTENSION)}) AS lang FROM q),
c AS (SELECT repo, lang, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, min(id)) AS k FROM l WHERE lang IS NOT NULL GROUP BY repo, lang)
SELECT repo, 'desconocido' AS project_type, string_agg(lang, ', ' ORDER BY k) AS languages FROM c WHERE k <= 4 GROUP BY repo""")
def _(spark, d):
    return P.project_summary(_repo_files(spark, d))


@query("module_breakdown", _PATHS + """, q AS (SELECT id % 5 AS repo, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(raíz)' END AS module, size::VARCHAR AS category, id FROM p),
c AS (SELECT repo, module, category, count(*) AS n, min(id) AS first FROM q GROUP BY ALL)
SELECT repo, module, arg_max(category, (n, -first)) AS category, CAST(sum(n) AS BIGINT) AS files FROM c GROUP BY ALL""")
def _(spark, d):
    files = _repo_files(spark, d).withColumn("category", F.col("size").cast("string")).withColumn("summary", F.col("path"))
    return P.module_breakdown(files).select("repo", "module", "category", "files")


@query("graph_degrees", "WITH e AS (SELECT l_orderkey % 100 AS g, l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT g AS diff_id, path, count(*) AS degree FROM (SELECT g, a AS path FROM e UNION ALL SELECT g, b FROM e) GROUP BY ALL")
def _(spark, d):
    return P.degrees(table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("diff_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


@query("pack_pieces")
def _(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("diff_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("f"), "l_partkey").alias("path"), F.col("l_linenumber").alias("part"), (F.col("l_quantity") * 40).cast("int").alias("tokens"))
    edges = p.select("diff_id", F.col("path").alias("a"), F.concat(F.col("path"), F.lit("0")).alias("b")).distinct()
    return P.pack_pieces(p, edges)


# --- diffs and manifests ----------------------------------------------------------------------------------------


def _diffs(spark, d):
    """A git diff out of each part: one file in one of four states, with a hunk."""
    k, n = F.col("p_partkey"), F.col("p_name")
    head = F.concat(F.lit("diff --git a/src/"), n, F.lit(".py b/src/"), n, F.when(k % 4 == 3, "2.py\n").otherwise(".py\n"))
    mode = F.when(k % 4 == 1, "new file mode 100644\n--- /dev/null\n").when(k % 4 == 3, F.concat(F.lit("similarity index 90%\nrename from src/"), n, F.lit(".py\nrename to src/"), n, F.lit("2.py\n--- a/src/"), n, F.lit(".py\n"))).otherwise(F.concat(F.lit("--- a/src/"), n, F.lit(".py\n")))
    to = F.when(k % 4 == 2, "+++ /dev/null\n").when(k % 4 == 3, F.concat(F.lit("+++ b/src/"), n, F.lit("2.py\n"))).otherwise(F.concat(F.lit("+++ b/src/"), n, F.lit(".py\n")))
    body = F.concat(F.lit("@@ -1,2 +1,2 @@\n"), F.repeat(F.lit("+x\n"), (k % 3 + 1).cast("int")), F.repeat(F.lit("-y\n"), (k % 2).cast("int")), F.lit(" z\n"))
    two = F.concat(head, mode, to, body, F.lit("diff --git a/img.png b/img.png\nBinary files a/img.png and b/img.png differ\n"))
    return spread(table(spark, d, "part"), "p_partkey").select(k.alias("diff_id"), two.alias("diff"))


@query("file_changes", """SELECT p_partkey AS diff_id, 'src/' || p_name || CASE WHEN p_partkey % 4 = 3 THEN '2.py' ELSE '.py' END AS path, CASE WHEN p_partkey % 4 = 3 THEN 'src/' || p_name || '.py' END AS old_path, (['modified', 'added', 'deleted', 'renamed'])[p_partkey % 4 + 1] AS status,
CAST(p_partkey % 3 + 1 AS INT) AS additions, CAST(p_partkey % 2 AS INT) AS deletions, false AS is_binary, 'python' AS language FROM part UNION ALL SELECT p_partkey, 'img.png', NULL, 'modified', 0, 0, true, NULL FROM part""")
def _(spark, d):
    return D.file_changes(_diffs(spark, d)).select("diff_id", "path", "old_path", "status", "additions", "deletions", "is_binary", "language")


_MAN = {
    "requirements.txt": ("PyPI", "+# c\n+{n}==1.{k}\n-old==2\n+git+https://h.example/{n}.git#egg={n}e\n", [("{n}", "1.{k}", False), ("{n}e", "git+https://h.example/{n}.git#egg={n}e", True)]),
    "Cargo.toml": ("crates.io", '+{n} = "0.{k}"\n+{n}g = { git = "https://h.example", version = "1.{k}" }\n', [("{n}", "0.{k}", False), ("{n}g", "1.{k}", True)]),
    "go.mod": ("Go", "+require h.example/{n} v1.{k}\n+replace h.example/{n} => ../local\n+\th.example/{n}b v0.{k}\n", [("h.example/{n}", "v1.{k}", False), ("h.example/{n}", "../local", True), ("h.example/{n}b", "v0.{k}", False)]),
    "package.json": ("npm", '@@ -1 +1 @@\n "scripts": {\n+  "lint": "x{k}"\n },\n "dependencies": {\n+  "{n}": "^1.{k}",\n+  "{n}u": "github:o/{n}"\n }\n', [("{n}", "^1.{k}", False), ("{n}u", "github:o/{n}", True)]),
    "package-lock.json": ("npm", '+ "node_modules/a/node_modules/{n}": {\n+  "version": "2.{k}",\n+  "version": "9.9"\n', [("{n}", "2.{k}", False)]),
    "yarn.lock": ("npm", '+"@s/{n}@^1.0", "@s/{n}@^2":\n+  version "3.{k}"\n', [("@s/{n}", "3.{k}", False)]),
    "poetry.lock": ("PyPI", '+[[package]]\n+name = "lost"\n+[[package]]\n+name = "{n}"\n+version = "4.{k}"\n', [("{n}", "4.{k}", False)]),
    "go.sum": ("Go", "+h.example/{n} v1.{k} h1:abc=\n+h.example/{n} v1.{k}/go.mod h1:def=\n", [("h.example/{n}", "v1.{k}", False)]),
    "composer.json": ("Packagist", '+ "ven/{n}": "^5.{k}",\n+ "ven/{n}d": "dev-main"\n', [("ven/{n}", "^5.{k}", False), ("ven/{n}d", "dev-main", True)]),
}


def _filled(text: str, sql: bool):
    if sql:
        return "replace(replace('" + text.replace("'", "''") + "', '{n}', replace(p_name, ' ', '-')), '{k}', CAST(p_partkey AS VARCHAR))"
    return F.replace(F.replace(F.lit(text), F.lit("{n}"), F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("{k}"), F.col("p_partkey").cast("string"))


_MAN_SQL = " UNION ALL ".join(f"SELECT p_partkey AS diff_id, 'x/{f}' AS manifest_path, '{eco}' AS ecosystem, {_filled(n, True)} AS name, {_filled(v, True)} AS version, {str(u).lower()} AS is_direct_url FROM part" for f, (eco, _, rows) in _MAN.items() for n, v, u in rows)


def _manifest_changes(spark, d) -> DataFrame:
    files = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f"x/{f}").alias("path"), _filled(h, False).alias("diff_hunk")) for i, (f, (_, h, _)) in enumerate(_MAN.items())))
    return spread(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("diff_id"), F.explode(files).alias("f")).select("diff_id", "f.*")


@query("dependency_changes", _MAN_SQL)
def _(spark, d):
    return manifests.dependency_changes(_manifest_changes(spark, d)).select("diff_id", "manifest_path", "ecosystem", "name", "version", "is_direct_url")


@query("dependency_changes_sql", _MAN_SQL)
def _(spark, d):
    from . import views

    _manifest_changes(spark, d).createOrReplaceTempView("changes")
    views.register(spark, "changes")
    return spark.sql("SELECT diff_id, manifest_path, ecosystem, name, version, is_direct_url FROM dependency_changes")


def _analysis(spark, d, config=None) -> A.Analysis:
    k, n = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("-"))
    req = F.concat(F.lit("diff --git a/requirements.txt b/requirements.txt\n--- a/requirements.txt\n+++ b/requirements.txt\n@@ -1 +1,2 @@\n+"), n, F.when(k % 5 == 0, "-dev").otherwise(""), F.lit("==1.0\n"))
    code = F.when(k % 7 == 0, F.lit("diff --git a/run.py b/run.py\n--- a/run.py\n+++ b/run.py\n@@ -1 +1 @@\n+eval(data)\n")).otherwise("")
    diffs = table(spark, d, "part").select(k.alias("diff_id"), F.concat(F.when(k % 3 == 0, req).otherwise(""), code).alias("diff"))
    refs = table(spark, d, "part").groupBy(n.alias("name")).agg(F.min("p_partkey").alias("ord")).withColumn("ecosystem", F.lit("pypi"))
    vuln = F.array(F.struct(F.lit("ADV-1").alias("id"), F.lit("bad").alias("summary"), F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L/PR:H/UI:N/S:U/C:H/I:H/A:H").alias("score"))).alias("severity"), F.array().cast("array<string>").alias("nominal"), F.lit(None).cast("string").alias("cvss")))
    none = F.filter(vuln, lambda _: F.lit(False))
    adv = table(spark, d, "part").select("p_name").distinct().select(F.lit("PyPI").alias("ecosystem"), n.alias("name"), F.lit("1.0").alias("version"), F.when(F.length("p_name") % 2 == 0, vuln).otherwise(none).alias("vulns"))
    rep = table(spark, d, "part").filter("p_partkey % 2 = 0").select(k.alias("diff_id"), (k % 100).alias("account_age_days"), F.lit(1).alias("public_repos"), F.lit(1).alias("followers"), (k % 4).alias("prior_contributions"), F.lit(True).alias("email_verified"), F.lit(False).alias("repo_signs"), F.lit(False).alias("commit_signed"), F.lit(None).cast("boolean").alias("key_seen"), F.lit(False).alias("prior_high_risk"))
    return A.analyze(diffs, refs, adv, rep, config=config)


_ANALYSIS = """WITH b AS (SELECT p_partkey AS id, p_name, p_partkey % 3 = 0 AS req, p_partkey % 5 = 0 AS dev, p_partkey % 7 = 0 AS code, p_partkey % 2 = 0 AS rep FROM part),
l AS (SELECT *, CASE WHEN code THEN 90 ELSE 0 END AS st, CASE WHEN req AND dev THEN 75 WHEN req THEN 10 ELSE 0 END AS de, CASE WHEN req AND NOT dev AND length(p_name) % 2 = 0 THEN 90 ELSE 0 END AS vu,
(CASE WHEN id % 100 < 30 THEN 10 ELSE 0 END) + (CASE WHEN id % 4 = 0 THEN 20 ELSE 0 END) AS re, CASE WHEN code OR (req AND dev) THEN 85 WHEN req THEN 30 ELSE 5 END AS se FROM b),
m AS (SELECT *, CAST(round_even((0.25::DOUBLE * st + 0.1::DOUBLE * de + 0.1::DOUBLE * vu + (CASE WHEN rep THEN 0.15::DOUBLE * re ELSE 0 END) + 0.4::DOUBLE * se) / (0.25::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + (CASE WHEN rep THEN 0.15::DOUBLE ELSE 0 END) + 0.4::DOUBLE), 0) AS INT) AS mean FROM l),
s AS (SELECT id, CASE WHEN code OR (req AND dev) THEN greatest(mean, 70) ELSE mean END AS score, code, req, dev FROM m)
SELECT id AS diff_id, score, CASE WHEN score >= 70 THEN 'rojo' WHEN score >= 40 THEN 'amarillo' ELSE 'verde' END AS verdict, CAST((CASE WHEN code THEN 1 ELSE 0 END) + (CASE WHEN req AND dev THEN 1 ELSE 0 END) AS BIGINT) AS malicious FROM s"""


@query("analyze_diffs", _ANALYSIS)
def _(spark, d):
    return _analysis(spark, d).results.select("diff_id", "score", "verdict", "malicious")


@query("analyze_short_circuit")
def _(spark, d):
    return _analysis(spark, d, A.Config(short_circuit=True)).results.select("diff_id", "score", "verdict")


_SHORT = _ANALYSIS[: _ANALYSIS.index(",\nm AS (SELECT")] + """,
m AS (SELECT *, code OR dev OR NOT req AS decided, 0.25::DOUBLE * st + 0.1::DOUBLE * de + 0.1::DOUBLE * vu + (CASE WHEN rep THEN 0.15::DOUBLE * re ELSE 0 END) AS top, 0.25::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE + (CASE WHEN rep THEN 0.15::DOUBLE ELSE 0 END) AS below FROM l),
s AS (SELECT *, CAST(round_even(CASE WHEN decided THEN top / below ELSE (top + 0.4::DOUBLE * se) / (below + 0.4::DOUBLE) END, 0) AS INT) AS score FROM m)
SELECT id AS diff_id, score, CASE WHEN code OR (req AND dev) THEN 'rojo' WHEN NOT req THEN 'verde' WHEN score >= 70 THEN 'rojo' WHEN score >= 40 THEN 'amarillo' ELSE 'verde' END AS verdict FROM s"""


@query("analyze_short_circuit_full", _SHORT)
def _(spark, d):
    """Without the sample of decided changes that is analysed anyway, which SQL can't tell."""
    return _analysis(spark, d, A.Config(short_circuit=True, audit_one_in=1 << 40)).results.select("diff_id", "score", "verdict")


_QUICK = _ANALYSIS[: _ANALYSIS.index(",\nm AS (SELECT")] + """,
m AS (SELECT *, CAST(round_even((0.25::DOUBLE * st + 0.1::DOUBLE * de + (CASE WHEN rep THEN 0.15::DOUBLE * re ELSE 0 END)) / (0.25::DOUBLE + 0.1::DOUBLE + (CASE WHEN rep THEN 0.15::DOUBLE ELSE 0 END)), 0) AS INT) AS score FROM l)
SELECT id AS diff_id, score, CASE WHEN score >= 70 THEN 'rojo' WHEN score >= 40 THEN 'amarillo' ELSE 'verde' END AS verdict FROM m"""


@query("quick_check", _QUICK)
def _(spark, d):
    return _analysis(spark, d, A.Config().without("semantic", "vulnerabilities")).results.select("diff_id", "score", "verdict")


@query("sarif_reports")
def _(spark, d):
    from ..operators import render

    a = _analysis(spark, d)
    return render.sarif(a.results, a.layers, a.findings)


@query("review_comments")
def _(spark, d):
    from ..operators import render

    a = _analysis(spark, d)
    return render.comments(a.results, a.layers)


@query("ci_annotations")
def _(spark, d):
    from ..operators import render

    a = _analysis(spark, d)
    return render.annotations(a.results, a.findings)


@query("corpus_chunks", "WITH c AS (SELECT doc_id, text, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS INT)) END AS k FROM documents) SELECT doc_id AS id, n, md5(substr(text, n * 900 + 1, 1000)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, k)) AS n FROM c)")
def _(spark, d):
    from ..sources.corpus import chunks

    return chunks(table(spark, d, "documents"), "doc_id", "text").select("id", "n", F.md5("chunk").alias("chunk"))


@query("corpus_split")
def _(spark, d):
    from ..sources.corpus import split_chunks

    return split_chunks(table(spark, d, "documents"), "doc_id", "text").select("id", "n", F.md5("chunk").alias("chunk"))


@query("file_pieces")
def _(spark, d):
    from ..operators import knowledge as N

    text = F.coalesce("text", F.lit(""))
    files = table(spark, d, "documents").select(F.col("doc_id").alias("diff_id"), F.lit(0).alias("ord"), F.concat(F.lit("f"), "doc_id").alias("path"), text.alias("content"), N.indented_ranges(text).alias("ranges"))
    return P.file_pieces(files, budget=300).select("diff_id", "path", "part", "parts", "tokens", F.md5("content").alias("content"))


# --- streams ----------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result, written as Parquet into the shared folder and read again; ``complete`` keeps the last batch."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/riskloom/stream_{uuid.uuid4().hex}"
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
    out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(out)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/rows"))
    else:
        writer = writer.format("parquet").option("path", f"{base}/rows")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query("stream_monthly_tokens", "SELECT user_id, strftime(ts, '%Y-%m') AS month, CAST(sum(event_id % 100) AS BIGINT) AS tokens_used FROM events GROUP BY ALL")
def _(spark, d):
    return _run(jobs.monthly_tokens(_event_stream(spark, d).withColumn("tokens", F.col("event_id") % 100)), "complete")


@query("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return _run(jobs.daily_counts(_event_stream(spark, d)), "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("stream_rate_limit", """WITH u AS (SELECT user_id, list_reduce(list_transform(list(epoch_us(ts) ORDER BY ts), lambda t: [t]), lambda a, x: CASE WHEN len(list_filter(a, lambda t: t > x[1] - 36000000000)) < 3 THEN list_append(a, x[1]) ELSE a END) AS taken FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, list_contains(taken, epoch_us(ts)) AS allowed FROM events JOIN u USING (user_id)""")
def _(spark, d):
    return _stamped(_run(jobs.sliding_limit(_event_stream(spark, d), "user_id", 3, 36_000), "append"))


@query("stream_quota", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, 1500 + 500 * (event_id % 4) AS cost, CASE user_id WHEN 3 THEN 10000 ELSE 50000 END AS most FROM events),
b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3000 > most AS degraded FROM e)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, degraded, CAST(sum(CASE WHEN degraded THEN 0 ELSE cost END) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS used FROM b""")
def _(spark, d):
    return _stamped(_run(jobs.quota(_event_stream(spark, d).withColumn("tool_calls", F.col("event_id") % 4), {"3": 10_000}, 50_000), "append"))


# --- cases, caches and structure --------------------------------------------------------------------------------


@query("advisory_cases", "SELECT 'advisory-ghsa-' || page_id AS case_id, '# T' || page_id || ' (GHSA-' || page_id || ')' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || 'Bad ' || page_id || chr(10) || 'end' || chr(10) || chr(10) || '## Packages' || chr(10) || chr(10) || '- p' || page_id || ' (npm): < 2' || CASE WHEN page_id % 2 = 0 THEN '; fixed in 2.1' ELSE '' END || chr(10) || chr(10) || '## Watch for' || chr(10) || chr(10) || 'p' || page_id AS body FROM pages WHERE page_id % 3 <> 0")
def _(spark, d):
    from ..operators import knowledge as N

    k = F.col("page_id")
    text = F.concat(F.lit("## Source: x (aa)\n\n# Bad "), k, F.lit("\n---\nend\ncredit: me\n"))
    package = F.array(F.struct(F.concat(F.lit("p"), k).alias("name"), F.lit("npm").alias("ecosystem"), F.lit("< 2").alias("affected"), F.when(k % 2 == 0, "2.1").alias("patched")))
    rows = table(spark, d, "pages").select(F.concat(F.lit("GHSA-"), k).alias("ghsa_id"), F.lit("malware").alias("type"), F.when(k % 3 != 0, F.concat(F.lit("T"), k)).alias("summary"), text.alias("description"), package.alias("packages"))
    return N.advisory_cases(rows)


@query("changed_cases", "SELECT p_name AS case_id, max(p_brand) AS body FROM part GROUP BY p_name HAVING max(p_brand) <> min(p_brand) OR min(p_partkey) % 2 = 1")
def _(spark, d):
    from ..operators import knowledge as N

    g = table(spark, d, "part").groupBy("p_name").agg(F.max("p_brand").alias("hi"), F.min("p_brand").alias("lo"), (F.min("p_partkey") % 2).alias("odd"))
    return N.changed_cases(g.filter("odd = 0").select(F.col("p_name").alias("case_id"), F.col("lo").alias("body")), g.select(F.col("p_name").alias("case_id"), F.col("hi").alias("body")))


@query("cache_plan", """WITH w AS (SELECT o_custkey AS request, o_orderkey AS ord, o_orderkey % 900 AS k FROM orders), c AS (SELECT DISTINCT event_id % 900 AS k FROM events WHERE event_id % 3 = 0 AND event_id < 900 AND ts > TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOURS),
r AS (SELECT w.*, c.k IS NOT NULL AS hit FROM w LEFT JOIN c ON w.k = c.k)
SELECT request, ord, CASE WHEN hit THEN 'cache' WHEN sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY request ORDER BY ord) <= 4 THEN 'fetch' ELSE 'limit' END AS source FROM r""")
def _(spark, d):
    from ..operators import knowledge as N

    name = lambda c: (F.lit("e").alias("ecosystem"), (c % 900).cast("string").alias("name"), F.lit("1").alias("version"))
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("ord"), *name(F.col("o_orderkey")))
    cache = table(spark, d, "events").filter("event_id % 3 = 0 AND event_id < 900").select(*name(F.col("event_id")), F.col("ts").cast("timestamp").alias("fetched_at"))
    return N.cache_plan(wanted, cache, "2024-01-02 00:00:00", 4).select("request", "ord", "source")


@query("cache_plan_full", """WITH w AS (SELECT o_custkey AS request, o_orderkey AS ord, o_orderkey AS k FROM orders), c AS (SELECT DISTINCT event_id AS k FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOURS),
r AS (SELECT w.*, c.k IS NOT NULL AS hit FROM w LEFT JOIN c ON w.k = c.k)
SELECT request, ord, CASE WHEN hit THEN 'cache' WHEN sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY request ORDER BY ord) <= 4 THEN 'fetch' ELSE 'limit' END AS source FROM r""")
def _(spark, d):
    from ..operators import knowledge as N

    name = lambda c: (F.lit("e").alias("ecosystem"), c.cast("string").alias("name"), F.lit("1").alias("version"))
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("ord"), *name(F.col("o_orderkey")))
    cache = table(spark, d, "events").select(*name(F.col("event_id")), F.col("ts").cast("timestamp").alias("fetched_at"))
    return N.cache_plan(wanted, cache, "2024-01-20 12:00:00", 4).select("request", "ord", "source")


@query("blocked_changes", SCORES + "SELECT event_id, repo, author FROM scores s WHERE (CASE WHEN repo IN ('org/repo1', 'org/repo2') THEN 1 ELSE 2 END, author) IN (SELECT (c_nationkey % 2 + 1, 'u' || c_custkey) FROM customer WHERE c_custkey < 40)")
def _(spark, d):
    from ..operators import knowledge as N

    s = scores(spark, d)
    repos = s.select("repo").distinct().withColumn("org_id", F.when(F.col("repo").isin("org/repo1", "org/repo2"), 1).otherwise(2))
    blocked = table(spark, d, "customer").filter("c_custkey < 40").select((F.col("c_nationkey") % 2 + 1).alias("org_id"), F.concat(F.lit("u"), "c_custkey").alias("login"))
    return N.blocked_changes(s.select("event_id", "repo", "author"), repos, blocked).select("event_id", "repo", "author")


@query("blocked_changes_full", SQL["blocked_changes"].replace(" WHERE c_custkey < 40", ""))
def _(spark, d):
    from ..operators import knowledge as N

    s = scores(spark, d)
    repos = s.select("repo").distinct().withColumn("org_id", F.when(F.col("repo").isin("org/repo1", "org/repo2"), 1).otherwise(2))
    blocked = table(spark, d, "customer").select((F.col("c_nationkey") % 2 + 1).alias("org_id"), F.concat(F.lit("u"), "c_custkey").alias("login"))
    return N.blocked_changes(s.select("event_id", "repo", "author"), repos, blocked).select("event_id", "repo", "author")


@query("layer_details", SCORES + "SELECT event_id, 'static' AS layer, static_score AS score, static_skipped AS skipped, CASE WHEN event_id % 3 = 0 THEN 'why ' || event_id ELSE '' END AS justification, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE nature END AS nature FROM scores UNION ALL SELECT event_id, 'semantic', coalesce(semantic_score, 0), coalesce(semantic_skipped, true), 'said', NULL FROM scores")
def _(spark, d):
    from ..operators import knowledge as N

    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"static": {"justification": "why '), "event_id", F.lit('", "threat_nature": "x"}}')))
    return N.layer_details(scores(spark, d).withColumn("findings_json", doc).withColumn("semantic_justification", F.lit("said")), ("static", "semantic"))


@query("distinct_authors", "SELECT o_custkey % 50 AS diff_id, min(o_orderkey) AS ord, o_orderpriority AS email, 'n' || min(o_orderkey) AS name, 'l' || min(o_orderkey) AS login FROM orders GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY o_custkey % 50, o_orderpriority"))
def _(spark, d):
    from ..operators import knowledge as N

    k = F.col("o_orderkey")
    return N.distinct_authors(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("diff_id"), k.alias("ord"), F.col("o_orderpriority").alias("email"), F.concat(F.lit("n"), k).alias("name"), F.concat(F.lit("l"), k).alias("login")))


@query("signs_commits", "SELECT repo, bool_or(verified) AS signs FROM (SELECT user_id AS repo, event_id % 37 = 0 AS verified, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k <= 20 GROUP BY repo")
def _(spark, d):
    from ..operators import knowledge as N

    return N.signs_commits(table(spark, d, "events").select(F.col("user_id").alias("repo"), "ts", (F.col("event_id") % 37 == 0).alias("verified")))


@query("python_structure", "SELECT p_partkey AS id, 'a' AS imports, 3 AS first, CAST(4 + p_size % 5 AS INT) AS last, 'def f' || p_partkey || '():' AS symbol FROM part")
def _(spark, d):
    from ..operators import knowledge as N

    k = F.col("p_partkey")
    code = F.concat(F.lit("import a\n\ndef f"), k, F.lit("():\n"), F.repeat(F.lit("    pass\n"), (F.col("p_size") % 5 + 1).cast("int")), F.lit("x = 1\n"))
    out = N.python_structure(table(spark, d, "part").select(k.alias("id"), code.alias("content")))
    return out.select("id", F.array_join("imports", ",").alias("imports"), F.col("ranges")[0]["start"].alias("first"), F.col("ranges")[0]["end"].alias("last"), N.symbols(F.col("content"), F.col("ranges"))[0].alias("symbol"))


@query("indented_ranges", "SELECT p_partkey AS id, 2 AS n, 1 AS a, CAST(p_size % 5 + 3 AS INT) AS z FROM part")
def _(spark, d):
    from ..operators import knowledge as N

    code = F.concat(F.lit("def a\n"), F.repeat(F.lit("  x\n"), (F.col("p_size") % 5 + 1).cast("int")), F.lit("end\n# note\ndef b\n  y\nend\n"))
    r = N.indented_ranges(code)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(r).alias("n"), r[0]["start"].alias("a"), (r[0]["end"] - 1).alias("z"))


@query("pushed_refs", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'create' ELSE 'update' END AS kind FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, d):
    k, zero = F.col("o_orderkey"), F.lit("0000000000")
    sha = F.concat(F.lit("a1"), k)
    line = F.concat_ws(" ", F.when(k % 3 == 0, zero).otherwise(sha), F.when(k % 3 == 1, zero).otherwise(sha), F.when(k % 7 != 0, F.concat(F.lit("r"), k)))
    rows = D.pushed_refs(table(spark, d, "orders").select(line.alias("value")))
    return rows.select(F.substr("ref", F.lit(2)).cast("long").alias("id"), "kind")


from . import review_queries, service_queries, source_queries, storage_queries  # noqa: E402, F401  register their queries with ``query``
