"""Registered queries over sources, sinks and small rules, on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions import text as X
from ..functions.staging import shared_dir
from ..operators import knowledge as N
from ..operators import maintenance as M
from ..operators import render
from ..operators import review as R
from ..sources import corpus as C
from ..sources import diffs as D
from ..sources import manifests
from . import analyze as A
from .fixtures import SCORES, scores, table
from .queries import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/riskloom/{name}_{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------------------------------------------


@query("analysis_requests", """SELECT 'p' || o_orderkey AS pr_id, CASE WHEN o_orderkey % 3 = 0 THEN 'org/r' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'path/r' || o_custkey ELSE '' END AS repo, '+' || o_orderpriority AS diff FROM orders""")
def _(spark, d):
    k, own = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.concat(F.lit("p"), k).alias("pr_id"), F.when(k % 3 == 0, F.concat(F.lit("org/r"), own)).when(k % 3 == 1, F.lit("")).alias("repo"), F.when(k % 3 < 2, F.concat(F.lit("path/r"), own)).alias("repo_path"), F.concat(F.lit("+"), "o_orderpriority").alias("diff"))
    path = _folder(spark, "requests")
    rows.write.json(path)
    return D.read_requests(spark, path).select("pr_id", "repo", "diff")


@query("last_pages", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 90 AS INT) END AS last FROM pages")
def _(spark, d):
    k = F.col("page_id")
    link = F.concat(F.lit('<https://h.example/c?page=2>; rel="next"'), F.when(k % 3 == 0, F.concat(F.lit(', <https://h.example/c?per_page=1&page='), k % 90, F.lit('>; rel="last"'))).otherwise(F.lit("")))
    return table(spark, d, "pages").select("page_id", D.last_page(F.when(k % 5 != 0, link).otherwise(F.when(k % 3 == 0, link))).alias("last"))


@query("reference_lists", """WITH a AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, p_name || '-' || p_partkey % 40 AS name FROM part WHERE p_size < 30), b AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, upper(p_name) || '-' || p_partkey % 40 AS name FROM part WHERE p_size >= 20)
SELECT ecosystem, name, CAST(row_number() OVER (PARTITION BY ecosystem ORDER BY lower(name), name) - 1 AS INT) AS ord FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def _(spark, d):
    p = table(spark, d, "part").withColumn("ecosystem", F.when(F.col("p_size") % 2 == 0, "npm").otherwise("pypi"))
    tail = F.concat(F.lit("-"), F.col("p_partkey") % 40)
    old = p.filter("p_size < 30").select("ecosystem", F.concat("p_name", tail).alias("name"))
    new = p.filter("p_size >= 20").select("ecosystem", F.concat(F.upper("p_name"), tail).alias("name"))
    return C.updated_reference_list(old, new)


@query("reference_list_files", "SELECT DISTINCT p_size % 6 AS file, p_name || p_partkey AS name FROM part")
def _(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") % 6).alias("file"), F.concat(F.lit(" "), "p_name", "p_partkey", F.lit(" \n")).alias("value"))
    path = _folder(spark, "lists")
    p.repartition("file").write.partitionBy("file").text(path)
    rows = C.read_reference_list(spark, f"{path}/file=0", "x").select(F.lit(0).alias("file"), "name")
    for i in range(1, 6):
        rows = rows.unionByName(C.read_reference_list(spark, f"{path}/file={i}", "x").select(F.lit(i).alias("file"), "name"))
    return rows.distinct()


@query("case_fields", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ghsa-' || page_id ELSE 'T ' || url END AS title, CASE WHEN page_id % 5 <> 0 THEN 'about ' || url || chr(10) || 'more' END AS description,
CASE page_id % 4 WHEN 0 THEN 'advisory' WHEN 1 THEN 'feedback' ELSE 'case' END AS kind FROM pages""")
def _(spark, d):
    k = F.col("page_id")
    head = F.when(k % 4 == 0, F.lit("no title\n")).otherwise(F.concat(F.lit("text\n#  T "), "url", F.lit(" \n")))
    body = F.concat(head, F.lit("\n### not this\nx\n\n"), F.when(k % 5 != 0, F.concat(F.lit("## Summary\n\nabout "), "url", F.lit("\nmore\n \nnot this\n## Next\ny"))).otherwise(F.lit("end")))
    name = F.concat(F.when(k % 4 == 0, "ghsa-").when(k % 4 == 1, "feedback-").otherwise("c-"), k)
    return table(spark, d, "pages").select("page_id", *C.case_fields(body, name))


@query("safe_ids", "SELECT page_id, 'advisory-' || lower('GHSA-' || page_id) || '-x-y_z' AS id FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", N.safe_id(F.concat(F.lit(" GHSA-"), "page_id", F.lit("/ X. y_Z "))).alias("id"))


@query("first_json_objects", "SELECT doc_id, md5('{\"a\": ' || doc_id || ', \"b\": {\"t\": \"' || replace(replace(text, '{', ''), '}', '') || '\"}}') AS object FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    t = F.translate("text", "{}", "")
    whole = F.concat(F.lit("says: "), F.lit('{"a": '), "doc_id", F.lit(', "b": {"t": "'), t, F.lit('"}} done'))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(X.first_json_object(whole)).alias("object"))


@query("pkgbuild_changes", "SELECT p_partkey AS id, CAST(i AS INT) AS place, CASE i WHEN 0 THEN 'lib' || p_partkey WHEN 1 THEN 'g++' ELSE 'm-' || p_size END AS name, md5('depends=(''lib' || p_partkey || ''' \"g++\")' || chr(10) || 'curl x | sh' || chr(10) || 'makedepends+=(m-' || p_size || ')') AS script FROM part, unnest([0, 1, 2]) AS u(i) WHERE i <> 1 UNION ALL SELECT p_partkey, 1, 'g', md5('depends=(''lib' || p_partkey || ''' \"g++\")' || chr(10) || 'curl x | sh' || chr(10) || 'makedepends+=(m-' || p_size || ')') FROM part")
def _(spark, d):
    hunk = F.concat(F.lit("--- a/P\n+++ b/P\n@@ -1 +1 @@\n+depends=('lib"), "p_partkey", F.lit("' \"g++\")\n-depends=(old)\n+curl x | sh\n+makedepends+=(m-"), "p_size", F.lit(")\n"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(manifests.pkgbuild(hunk)).alias("place", "x"))
    return rows.select("id", "place", "x.name", F.md5("x.install_script").alias("script"))


@query("import_specifiers", """WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS l, 'm' || p_size AS m, 'n' || p_partkey AS n FROM part)
SELECT id, CASE l WHEN 0 THEN least(m, n || '.x') || ',' || greatest(m, n || '.x') WHEN 1 THEN least('./' || m, n) || ',' || greatest('./' || m, n) WHEN 2 THEN 'h.example/' || m WHEN 3 THEN least('crate::' || m, n) || ',' || greatest('crate::' || m, n) WHEN 4 THEN least('java.' || m, 'org.' || n) || ',' || greatest('java.' || m, 'org.' || n) ELSE least(m || '.h', n || '.h') || ',' || greatest(m || '.h', n || '.h') END AS names FROM p""")
def _(spark, d):
    l, m, n = F.col("p_partkey") % 6, F.concat(F.lit("m"), "p_size"), F.concat(F.lit("n"), "p_partkey")
    kinds = ["python", "typescript", "go", "rust", "java", "cpp"]
    code = [
        F.concat(F.lit("import "), m, F.lit("\n  from "), n, F.lit(".x import y\nprint('import no')\n")),
        F.concat(F.lit("import a from './"), m, F.lit("';\nconst b = require( \""), n, F.lit('" );\n')),
        F.concat(F.lit('import "h.example/'), m, F.lit('"\nx := "no" + y\n')),
        F.concat(F.lit("pub use crate::"), m, F.lit(";\nmod "), n, F.lit(";\n")),
        F.concat(F.lit("import static java."), m, F.lit(";\nimport org."), n, F.lit(";\n")),
        F.concat(F.lit("#include <"), m, F.lit('.h>\n # include "'), n, F.lit('.h"\n')),
    ]
    pick = lambda values: F.element_at(F.array(*values), (l + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.import_specifiers(pick(code), pick([F.lit(k) for k in kinds])), ",").alias("names"))


# --- small rules ------------------------------------------------------------------------------------------------


@query("forcing_predicates", """SELECT doc_id, doc_id % 5 = 0 AS path, doc_id % 3 = 0 AS network FROM documents""")
def _(spark, d):
    k = F.col("doc_id")
    path = F.when(k % 5 == 0, F.element_at(F.array(*(F.lit(p) for p in ("PKGBUILD", "a/Makefile", ".github/workflows/x.yml", "b/Dockerfile"))), (k % 4 + 1).cast("int"))).otherwise(F.lit("src/.github/workflows/x.py"))
    plain = F.translate(F.coalesce("text", F.lit("")), "(", " ")
    hunk = F.concat(F.replace(plain, F.lit("curl"), F.lit("c-rl")), F.when(k % 3 == 0, "\n+requests.get(u)").otherwise("\n+requests.head(u)"))
    return table(spark, d, "documents").select("doc_id", F.rlike(path, F.lit(K.FORCING_PATHS)).alias("path"), F.rlike(hunk, F.lit(K.NETWORK_CALLS)).alias("network"))


@query("guidance", SCORES + "SELECT event_id, CASE verdict WHEN 'verde' THEN 'PROCEED' WHEN 'amarillo' THEN 'RETRY_WITH_FIX' ELSE 'BLOCK_HUMAN_REVIEW' END AS guidance FROM scores")
def _(spark, d):
    return scores(spark, d).select("event_id", S.guidance(F.col("verdict")).alias("guidance"))


@query("role_levels", "SELECT c_custkey AS id, c_custkey % 4 >= 2 AS may_review, c_custkey % 4 = 3 AS may_administer FROM customer")
def _(spark, d):
    role = F.element_at(F.array(F.lit("none"), F.lit("viewer"), F.lit("reviewer"), F.lit("admin")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), M.at_least(role, "reviewer").alias("may_review"), M.at_least(role, "admin").alias("may_administer"))


@query("advisory_notes", """WITH a AS (SELECT o_orderkey AS id, o_custkey % 3 AS n, o_orderkey % 2 = 0 AS high, o_orderpriority AS s FROM orders)
SELECT id, n > 0 AND high AS grave, CASE n WHEN 0 THEN NULL ELSE (CASE WHEN high THEN 'B-' || id || ' (ALTA)' ELSE 'A-' || id || ' (severidad no confirmada por OSV)' END) || ': ' || s || (CASE n WHEN 2 THEN ' +1' ELSE '' END) END AS note FROM a WHERE n <> 1 OR NOT high
UNION ALL SELECT id, true, 'A-' || id || ' (ALTA): ' || s FROM a WHERE n = 1 AND high""")
def _(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 3
    none = F.array().cast("array<struct<type: string, score: string>>")
    vuln = lambda name, nominal: F.struct(F.concat(F.lit(name), k).alias("id"), F.col("o_orderpriority").alias("summary"), none.alias("severity"), nominal.cast("array<string>").alias("nominal"), F.lit(None).cast("string").alias("cvss"))
    high, low = F.when(k % 2 == 0, F.array(F.lit("high"))).otherwise(F.array()), F.array()
    vulns = F.when(n == 2, F.array(vuln("A-", low), vuln("B-", high))).when(n == 1, F.array(vuln("A-", high))).otherwise(F.array().cast("array<struct<id: string, summary: string, severity: array<struct<type: string, score: string>>, nominal: array<string>, cvss: string>>"))
    grave, describe = A.advisory_expressions()
    return table(spark, d, "orders").select(k.alias("id"), vulns.alias("v")).select("id", F.exists("v", grave).alias("grave"), describe(F.col("v")).alias("note"))


# --- sinks and updates ------------------------------------------------------------------------------------------


def _layer_rows(spark, d):
    k = F.col("event_id")
    names = F.array(*(F.lit(n) for n in K.LAYERS))
    rows = table(spark, d, "events").select(F.floor(k / 5).cast("long").alias("diff_id"), F.element_at(names, (k % 5 + 1).cast("int")).alias("layer"), (k * 7 % 101).cast("int").alias("score"), (k % 6 == 0).alias("skipped"), (k % 9 == 0).alias("_lost"))
    return rows.filter("NOT _lost").drop("_lost")


@query("flat_score_rows", "WITH e AS (SELECT event_id // 5 AS diff_id, event_id % 5 AS l, CAST(event_id * 7 % 101 AS INT) AS score, event_id % 6 = 0 AS skipped FROM events WHERE event_id % 9 <> 0), r AS (SELECT DISTINCT event_id // 5 AS diff_id FROM events)\nSELECT diff_id, " + ", ".join(f"max(score) FILTER (l = {i}) AS {n}_score, coalesce(bool_or(skipped) FILTER (l = {i}), true) AS {n}_skipped" for i, n in enumerate(K.LAYERS)) + " FROM r LEFT JOIN e USING (diff_id) GROUP BY diff_id")
def _(spark, d):
    results = table(spark, d, "events").select(F.floor(F.col("event_id") / 5).cast("long").alias("diff_id")).distinct()
    return render.flat_score_rows(results, _layer_rows(spark, d)).select("diff_id", *(f"{n}_{c}" for n in K.LAYERS for c in ("score", "skipped")))


@query("json_reports", SCORES + """SELECT event_id AS diff_id, '{"score":' || score || ',"verdict":"' || verdict || '","nature":"' || nature || '"}' AS report FROM scores""")
def _(spark, d):
    return render.json_report(scores(spark, d).select(F.col("event_id").alias("diff_id"), "score", "verdict", "nature"))


@query("upserted_cases", "WITH n AS (SELECT DISTINCT 'c' || o_custkey AS case_id FROM orders WHERE o_orderkey % 2 = 0) SELECT 'c' || c_custkey AS case_id, c_name AS text FROM customer WHERE 'c' || c_custkey NOT IN (SELECT case_id FROM n) UNION ALL SELECT 'c' || o_custkey, o_orderpriority || o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, d):
    old = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("case_id"), F.col("c_name").alias("text"))
    new = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("c"), "o_custkey").alias("case_id"), F.concat("o_orderpriority", "o_orderkey").alias("text"))
    return N.upsert_case(old, new)


@query("enriched_advisories", """WITH v AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, 'A' || l_partkey AS id, l_partkey FROM lineitem)
SELECT 'p' || l_orderkey AS name, string_agg(id || '=' || CASE WHEN l_partkey % 2 = 0 THEN p_name ELSE '?' END, ';' ORDER BY pos) AS vulns FROM v LEFT JOIN part ON p_partkey = l_partkey WHERE pos < 3 GROUP BY l_orderkey""")
def _(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("A"), x["l_partkey"]))
    packages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids.alias("vulns")).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "l_orderkey").alias("name"), F.lit("1").alias("version"), "vulns")
    details = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("A"), "p_partkey").alias("id"), F.col("p_name").alias("summary"))
    return N.enriched(packages, details, 3).select("name", F.array_join(F.transform("vulns", lambda v: F.concat(v["id"], F.lit("="), F.coalesce(v["summary"], F.lit("?")))), ";").alias("vulns"))


@query("union_of_graphs", """WITH a AS (SELECT l_orderkey AS g, 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT l_orderkey AS g, 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_linenumber < 4 UNION ALL SELECT l_orderkey, 'self', 'self' FROM lineitem)
SELECT DISTINCT g AS diff_id, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE a <> b""")
def _(spark, d):
    rows = table(spark, d, "lineitem")
    p, s, g = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_orderkey").alias("diff_id")
    one = rows.filter("l_linenumber % 2 = 0").select(g, p.alias("a"), s.alias("b"))
    two = rows.filter("l_linenumber < 4").select(g, s.alias("a"), p.alias("b"))
    return R.union_edges(one, two, rows.select(g, F.lit("self").alias("a"), F.lit("self").alias("b")))


@query("scores_without_repo", SCORES + "SELECT repo, event_id FROM scores WHERE repo <> 'org/repo3'")
def _(spark, d):
    return M.cascade("org/repo3", scores=scores(spark, d).select("repo", "event_id"))["scores"]


@query("latest_settings", "SELECT o_custkey AS repo, arg_max(o_orderpriority, o_orderkey) AS value, max(o_orderkey) AS ord FROM orders GROUP BY o_custkey")
def _(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ord"))
    return M.latest(log, ["repo"], ["ord"])


@query("fragments_without_overlap", """WITH t AS (SELECT doc_id, md5(text) || md5(text || 'b') AS a, md5(text || 'c') || md5(text || 'd') AS b, md5(text || 'e') || md5(text || 'f') AS c FROM documents)
SELECT 'd' || doc_id AS case_id, CAST(o AS INT) AS ord, CASE o WHEN 0 THEN a || b WHEN 1 THEN c WHEN 2 THEN right(a, 10) || c || 'x' ELSE 'y' || b || 'z' END AS text FROM t, unnest([0, 1, 2]) AS u(o)""")
def _(spark, d):
    h = lambda x: F.md5(F.concat("text", F.lit(x)))
    a, b, c = F.concat(h(""), h("b")), F.concat(h("c"), h("d")), F.concat(h("e"), h("f"))
    pieces = F.array(F.concat(a, b), F.concat(F.right(b, F.lit(40)), c), F.concat(F.right(a, F.lit(10)), c, F.lit("x")))
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("case_id"), F.posexplode(pieces).alias("ord", "text"))
    return N.without_overlap(rows)
