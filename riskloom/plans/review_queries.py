"""Registered queries over reviews, proposed rules, caches and graphs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import history as H
from ..operators import packing as P
from ..operators import review as R
from .fixtures import SCORES, scores, table
from .queries import query

_NEAR = " OR ".join(f"abs(score - {x}) <= {K.BORDERLINE_MARGIN}" for x in (K.YELLOW, K.RED))


@query("reviewed_scores", SCORES + """, log AS (SELECT o_custkey AS event_id, o_orderkey AS ord, ['feedback', 'accept', 'clear'][o_orderkey % 3 + 1] AS action, ' ' || o_orderpriority AS value, o_orderkey * 2 AS stamp FROM orders),
m AS (SELECT event_id, arg_max(value, ord) AS value FROM log WHERE action = 'feedback' GROUP BY event_id),
a AS (SELECT event_id, arg_max(action, ord) AS action, arg_max(value, ord) AS value, max(ord) * 2 AS stamp FROM log WHERE action <> 'feedback' GROUP BY event_id)
SELECT event_id, CASE WHEN m.event_id IS NULL THEN human_feedback ELSE m.value END AS human_feedback, CASE WHEN action = 'accept' THEN lower(trim(a.value)) END AS accepted_by, CASE WHEN action = 'accept' THEN stamp END AS accepted_at
FROM scores LEFT JOIN m USING (event_id) LEFT JOIN a USING (event_id)""")
def _(spark, d):
    k = F.col("o_orderkey")
    action = F.element_at(F.array(F.lit("feedback"), F.lit("accept"), F.lit("clear")), (k % 3 + 1).cast("int"))
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), k.alias("ord"), action.alias("action"), F.concat(F.lit(" "), "o_orderpriority").alias("value"), (k * 2).alias("at"))
    return R.reviewed(scores(spark, d), log).select("event_id", "human_feedback", "accepted_by", "accepted_at")


@query("constraint_violations", SCORES + """, roles AS (SELECT 'u' || o_custkey AS user_login, 'r' || o_orderkey % 3 AS repo, ['mantenedor', 'revisor', 'dueño'][o_orderkey % 3 + 1] AS role FROM orders)
SELECT 'feedback' AS rule, CAST(event_id AS VARCHAR) AS key, 1 AS n FROM scores WHERE human_feedback NOT IN ('correcto', 'falso_positivo')
UNION ALL SELECT 'role', user_login || '@' || repo, count(*) FROM roles WHERE role NOT IN ('mantenedor', 'revisor') GROUP BY user_login, repo
UNION ALL SELECT 'unique_role', user_login || '@' || repo, count(*) FROM roles GROUP BY user_login, repo HAVING count(*) > 1""")
def _(spark, d):
    k = F.col("o_orderkey")
    role = F.element_at(F.array(F.lit("mantenedor"), F.lit("revisor"), F.lit("dueño")), (k % 3 + 1).cast("int"))
    roles = table(spark, d, "orders").select(F.concat(F.lit("u"), "o_custkey").alias("user_login"), F.concat(F.lit("r"), k % 3).alias("repo"), role.alias("role"))
    return R.violations(scores(spark, d), roles)


_PROPOSED = """WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '9x' ELSE 'r' || p_partkey || '_x' END AS name, CASE p_partkey % 7 WHEN 0 THEN 'Web' ELSE 'web' END AS category,
CASE p_partkey % 3 WHEN 0 THEN ' ' ELSE p_name END AS rationale, p_size AS n, p_partkey % 11 = 0 AS other FROM part)
"""


@query("rule_problems", _PROPOSED + """SELECT id, CASE WHEN name = '9x' THEN 'name' WHEN category = 'Web' THEN 'category' WHEN n % 50 = 49 THEN 'size' WHEN trim(rationale) = '' THEN 'rationale' WHEN n % 4 <> 1 THEN 'count' WHEN other THEN 'identifier' END AS problem FROM p""")
def _(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 5 == 0, "9x").otherwise(F.concat(F.lit("r"), k, F.lit("_x")))
    rule = F.concat(F.lit("private rule "), F.when(k % 11 == 0, F.concat(name, F.lit("y"))).otherwise(name), F.lit(' {\n  strings:\n    $a = "no rule here"\n  condition: any of them\n}\n'))
    source = F.concat(F.repeat(rule, (n % 4).cast("int")), F.when(n % 50 == 49, F.repeat(F.lit("// pad\n"), K.MAX_RULE_CHARS // 7 + 1)).otherwise(F.lit("")))
    rows = table(spark, d, "part").select(k.alias("id"), R.rule_problem(name, F.when(k % 7 == 0, "Web").otherwise(F.lit("web")), source, F.when(k % 3 == 0, " ").otherwise(F.col("p_name"))).alias("problem"))
    return rows


_RULES = [
    ("words", 'rule two_of\n{\n  meta:\n    risk_score = 75\n  strings:\n    $a = "The" nocase\n    $b = "data"\n    $c = "model"\n  condition:\n    2 of them\n}'),
    ("words", 'rule every\n{\n  strings:\n    $a = "a"\n    $b = "Z" nocase\n  condition:\n    all of them\n}'),
    ("quotes", 'rule quoted\n{\n  meta:\n    risk_score = "high"\n  strings:\n    $a = "\\"" \n    $b = "--"\n  condition: any of them\n}'),
    ("hex", "rule other\n{\n  strings:\n    $a = { 41 42 }\n  condition: any of them\n}"),
]


@query("text_rule_hits", """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents)
SELECT doc_id, 'words.two_of' AS rule_id, 75 AS score FROM t WHERE contains(l, 'the')::INT + contains(t, 'data')::INT + contains(t, 'model')::INT >= 2
UNION ALL SELECT doc_id, 'words.every', 60 FROM t WHERE contains(t, 'a') AND contains(l, 'z')
UNION ALL SELECT doc_id, 'quotes.quoted', 60 FROM t WHERE contains(t, '"') OR contains(t, '--')""")
def _(spark, d):
    rules = R.text_rules(spark.createDataFrame(_RULES, "category string, source string"))
    return R.text_rule_hits(table(spark, d, "documents"), rules, ["doc_id"], "text")


@query("cache_upsert", "SELECT key, CASE WHEN v.key2 IS NULL THEN old ELSE new END AS value FROM (SELECT p_partkey AS key, 'old' || p_size AS old, NULL AS x FROM part) LEFT JOIN (SELECT l_partkey AS key2, 'new' || max(l_orderkey) AS new FROM lineitem GROUP BY l_partkey) v ON key = key2 UNION ALL SELECT l_partkey, 'new' || max(l_orderkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey")
def _(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("old"), "p_size").alias("value"))
    new = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.concat(F.lit("new"), "l_orderkey").alias("value"), F.col("l_orderkey").alias("ord"))
    return R.upsert(old, new, ["key"], "ord")


@query("graph_replace", "SELECT 'r' || o_custkey AS repo, 'f' || o_orderkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) UNION ALL SELECT 'r' || c_custkey, 'n' || i FROM customer, unnest([1, 2]) AS u(i) WHERE c_nationkey < 12")
def _(spark, d):
    old = table(spark, d, "orders").select(F.concat(F.lit("r"), "o_custkey").alias("repo"), F.concat(F.lit("f"), "o_orderkey").alias("path"))
    built = table(spark, d, "customer").filter("c_nationkey < 12").select(F.concat(F.lit("r"), "c_custkey").alias("repo"), F.explode(F.array(F.lit("n1"), F.lit("n2"))).alias("path"))
    return R.replace_groups(old, built, "repo")


@query("graph_view", """SELECT repo, coalesce(status, 'pending') AS status, overview, coalesce(n, 0) AS n_nodes, coalesce(paths, '') AS paths FROM (SELECT 'r' || c_custkey AS repo, c_custkey FROM customer)
LEFT JOIN (SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'ready' ELSE 'error' END AS status, c_name AS overview FROM customer WHERE c_nationkey % 2 = 0) USING (c_custkey)
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, string_agg('f' || o_orderkey, ',' ORDER BY 'f' || o_orderkey) AS paths FROM orders GROUP BY o_custkey) USING (c_custkey)""")
def _(spark, d):
    c, repo = table(spark, d, "customer"), F.concat(F.lit("r"), "c_custkey").alias("repo")
    built = c.filter("c_nationkey % 2 = 0").select(repo, F.when(F.col("c_nationkey") % 4 == 0, "ready").otherwise("error").alias("status"), F.col("c_name").alias("overview"))
    nodes = table(spark, d, "orders").select(F.concat(F.lit("r"), "o_custkey").alias("repo"), F.concat(F.lit("f"), "o_orderkey").alias("path"))
    return R.graph_view(c.select(repo), built, nodes).withColumn("paths", F.array_join("paths", ","))


@query("repo_overview", SCORES + """, kinds AS (SELECT 'org/repo' || (s_suppkey % 11) AS repo, arg_min(CASE WHEN s_suppkey % 3 = 0 THEN 'audited' ELSE 'own' END, s_suppkey) AS kind FROM supplier GROUP BY 1)
SELECT coalesce(s.repo, k.repo) AS repo, coalesce(prs, 0) AS prs, CASE WHEN kind = 'audited' THEN 'audited' ELSE 'own' END AS source FROM (SELECT repo, count(*) AS prs FROM scores GROUP BY repo) s FULL JOIN kinds k ON s.repo = k.repo""")
def _(spark, d):
    k = F.col("s_suppkey")
    monitored = table(spark, d, "supplier").select(F.concat(F.lit("org/repo"), k % 11).alias("repo"), k.alias("ord"), F.when(k % 3 == 0, "audited").otherwise("own").alias("monitor_type"))
    return R.repo_overview(H.repo_metrics(scores(spark, d)), monitored).select("repo", "prs", "source")


@query("content_hash", "SELECT o_custkey AS folder, CASE WHEN NOT bool_or(o_orderkey % 1000 = 3) THEN 'sha256:' || sha256(string_agg(o_orderpriority || chr(10), '' ORDER BY 'f' || o_orderkey)) END AS hash FROM orders GROUP BY o_custkey")
def _(spark, d):
    k = F.col("o_orderkey")
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), F.concat(F.lit("f"), k).alias("path"), F.concat("o_orderpriority", F.lit("\n")).alias("content"), (k % 1000 == 3).alias("is_link"))
    return R.content_hash(files, "folder")


@query("brace_ranges", "SELECT doc_id, CAST(2 * i - 1 AS INT) AS first, CAST(2 * i AS INT) AS last FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def _(spark, d):
    clean = F.regexp_replace("text", r"[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", " ")
    code = F.array_join(F.transform(F.split(clean, "\n"), lambda x: F.concat(F.lit("fn f('}') { if (1) {} // "), x, F.lit("\n} /* } */"))), "\n")
    # `if (1) {}` is nested, so a block ends with the brace of the next line
    return table(spark, d, "documents").select("doc_id", F.explode(R.brace_ranges(code)).alias("r")).select("doc_id", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


@query("unverified_paths", "SELECT doc_id, 'src/' || source || '.py,lib/' || doc_id AS paths FROM documents")
def _(spark, d):
    mark = F.lit(f"12 {K.UNVERIFIED} ---\n")
    first = F.concat(F.lit("--- src/"), "source", F.lit(".py: "), mark)
    plain = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("---"), F.lit("==")), F.lit(K.UNVERIFIED), F.lit("read"))
    prompt = F.concat(first, plain, F.lit("\n--- lib/"), F.col("doc_id").cast("string"), F.lit(": a.c: "), mark, first, F.lit("--- ok.py (added) ---\n"))
    return table(spark, d, "documents").select("doc_id", F.array_join(R.unverified_paths(prompt), ",").alias("paths"))


@query("budgeted_fill", """WITH f AS (SELECT user_id AS diff_id, event_id AS ord, event_id % 13 = 0 AS flagged, event_id % 3 AS n, CAST(floor(value) AS INT) % 300 AS w, event_id % 4 AS s FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY NOT flagged, CASE s WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END, ord) AS place FROM f),
q AS (SELECT *, coalesce(sum(CASE WHEN flagged THEN w WHEN n > 0 THEN w // 2 ELSE 9 END) OVER (PARTITION BY diff_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p)
SELECT diff_id, ord, CAST(place AS INT) AS place, CASE WHEN flagged THEN 'whole' WHEN used + 20 >= 2000 THEN 'no_budget' WHEN n > 0 THEN 'excerpt' ELSE 'unverified' END AS form FROM q""")
def _(spark, d):
    i, w = F.col("event_id"), F.floor("value").cast("int") % 300
    status = F.when(i % 4 == 0, "added").when(i % 4 == 3, "deleted").when(i % 4 == 1, "modified").otherwise("renamed")
    files = table(spark, d, "events").select(F.col("user_id").alias("diff_id"), i.alias("ord"), status.alias("status"), (i % 13 == 0).alias("flagged"), (i % 3).alias("n_matches"), w.alias("whole_tokens"), F.floor(w / 2).alias("excerpt_tokens"), F.lit(9).alias("marker_tokens"))
    return R.budgeted_fill(P.truncation_order(files), 2000, head_tokens=20).select("diff_id", "ord", "place", "form")


@query("winning_calls", f"""WITH c AS (SELECT user_id AS diff_id, event_id AS ord, CAST(event_id * 7 % 59 AS INT) AS score FROM events WHERE event_id % 2 = 0),
b AS (SELECT diff_id, arg_max(ord, (score, -ord)) AS ord, max(score) AS score FROM c GROUP BY diff_id),
s AS (SELECT diff_id, max(score) AS top, count(*) AS n FROM (SELECT user_id AS diff_id, event_id % 5 AS k, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id * 11 % 80 AS INT) END AS score FROM events WHERE event_id % 2 = 1) WHERE k <= {K.RESAMPLES} AND score IS NOT NULL GROUP BY diff_id)
SELECT diff_id, ord, CASE WHEN {_NEAR} THEN greatest(score, top) ELSE score END AS score, CASE WHEN {_NEAR} THEN coalesce(n, 0) ELSE 0 END AS n_samples FROM b LEFT JOIN s USING (diff_id)""")
def _(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    calls = e.filter("event_id % 2 = 0").select(F.col("user_id").alias("diff_id"), i.alias("ord"), (i * 7 % 59).cast("int").alias("score"))
    samples = e.filter("event_id % 2 = 1").select(F.col("user_id").alias("diff_id"), (i % 5).alias("k"), F.when(i % 3 != 0, (i * 11 % 80).cast("int")).alias("score"))
    return R.winning_call(calls, samples)
