"""Steps whose cost must not grow faster than their input, or whose work must be dealt to all tasks."""

import random
import time

from pyspark.sql import functions as F

from riskloom.functions import text as X
from riskloom.operators import access as A
from riskloom.operators import knowledge as N
from riskloom.operators import packing as P
from riskloom.operators import review as R
from riskloom.plans import analyze as L
from riskloom.plans import queries as Q

SMOKE = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_tables_of_costly_rows_are_dealt_to_all_tasks(spark):
    for rows in (Q._diffs(spark, SMOKE), Q._manifest_changes(spark, SMOKE)):
        assert rows.rdd.getNumPartitions() >= 4


def test_an_analysis_deals_its_diffs_to_all_tasks(spark):
    diff = "diff --git a/run.py b/run.py\n--- a/run.py\n+++ b/run.py\n@@ -1 +1 @@\n+plain\n"
    diffs = spark.range(8).select(F.col("id").alias("diff_id"), F.lit(diff).alias("diff")).coalesce(1)
    reference = spark.createDataFrame([], "ecosystem string, ord int, name string")
    advisories = spark.createDataFrame([], "ecosystem string, name string, version string, vulns array<struct<id: string>>")
    reputation = spark.createDataFrame([], "diff_id long")
    config = L.Config().without("dependencies", "vulnerabilities", "reputation", "semantic")
    out = L.analyze(diffs, reference, advisories, reputation, config=config)
    assert out.changes.rdd.getNumPartitions() >= 4 and out.changes.count() == 8
    assert sorted((r.diff_id, r.verdict) for r in out.results.collect()) == [(i, "verde") for i in range(8)]


def test_lines_are_split_once(spark):
    df = spark.createDataFrame([(0, "@@ -1 +1 @@\n+a\n-b\n--- c\n+++d\n e"), (1, "+a"), (2, ""), (3, None), (4, "x\n@@\n++\r\n-")], "i int, h string")
    a, b = X.line_counts(F.col("h"))
    out = df.select("i", a.alias("a"), b.alias("b"))
    assert {r.i: (r.a, r.b) for r in out.collect() if r.i != 3} == {0: (1, 1), 1: (0, 0), 2: (0, 0), 4: (1, 1)}
    assert _plan(out).count("split(") == 2  # once for each count


def test_symbols_split_a_text_once(spark):
    df = spark.createDataFrame([("def a():\n  pass\nclass B:\n  x = 1", [(1, 2), (3, 4), (9, 9)])], "t string, r array<struct<start: int, end: int>>")
    out = df.select(N.symbols(F.col("t"), F.col("r")).alias("s"))
    assert out.first().s == ["def a():", "class B:"]
    assert _plan(out).count("split(") == 1  # not once a range


def test_fragments_of_many_cases_in_one_batch(spark):
    a, b = "a" * 30 + "b" * 30, "c" * 25
    rows = [("x", 1, "b" * 30 + b), ("x", 0, a), ("x", 2, b + "d"), ("y", 0, a)]
    out = N.without_overlap(spark.createDataFrame(rows, "case_id string, ord int, text string"))
    assert sorted(tuple(r) for r in out.collect()) == [("x", 0, a), ("x", 1, b), ("x", 2, "d"), ("y", 0, a)]
    assert "FlatMapGroupsInPandas" not in _plan(out)


def test_a_chunk_of_many_paths(spark):
    n = 60_000
    p = spark.range(n).select(F.lit(1).alias("diff_id"), "id", F.col("id").alias("ord"), F.concat(F.lit("f"), "id").alias("path"), F.lit(0).alias("part"), F.lit(0).alias("tokens"))
    none = p.limit(0).select("diff_id", F.col("path").alias("a"), F.col("path").alias("b"))
    P.pack_pieces(p.limit(10), none).collect()
    began = time.time()
    assert P.pack_pieces(p, none).filter("chunk = 0").count() == n
    assert time.time() - began < 15


def test_texts_are_searched_in_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "TEXT_ROWS", 2)
    rules = spark.createDataFrame([("r", [("a", False)], 1, 5)], "rule_id string, strings array<struct<text: string, nocase: boolean>>, needed int, score int")
    texts = spark.range(7).select("id", F.when(F.col("id") % 2 == 0, "xax").otherwise("b").alias("t")).coalesce(1)
    assert sorted(tuple(r) for r in R.text_rule_hits(texts, rules, ["id"], "t").collect()) == [(i, "r", 5) for i in (0, 2, 4, 6)]


def test_a_block_list_sorts_its_log_once(spark):
    dice = random.Random(3)
    old = [("o", u, " r0 ", "x", -1) for u in "abc"]
    log = [("o", i, dice.choice(["add", "remove"]), dice.choice("abcde"), f"r{i}", "me", i) for i in range(60)]
    state, refused = {u: (r, by, at) for _, u, r, by, at in old}, []
    for _, i, action, user, reason, by, at in log:
        if (user in state) == (action == "add"):
            refused.append(i)
        elif action == "add":
            state[user] = (reason, by, at)
        else:
            del state[user]
    now, no = A.block_list(spark.createDataFrame(old, "org_id string, author_login string, reason string, blocked_by string, blocked_at int"), spark.createDataFrame(log, "org_id string, ord int, action string, author_login string, reason string, by string, at int"))
    assert {r.author_login: (r.reason, r.blocked_by, r.blocked_at) for r in now.collect()} == state
    assert sorted(r.ord for r in no.collect()) == refused
    assert "Join" not in _plan(now) and "Aggregate" not in _plan(now) and _plan(now).count("Window [") == 1


def test_files_are_cut_in_slices(spark, monkeypatch):
    monkeypatch.setattr(P, "FILE_ROWS", 2)
    text = "\n".join(f"def f{i}():\n  return {i}" for i in range(40))
    files = spark.range(7).select(F.col("id").alias("diff_id"), F.lit(0).alias("ord"), F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") % 3 == 0, "x").otherwise(text).alias("content")).coalesce(1)
    out = P.file_pieces(files.withColumn("ranges", N.indented_ranges(F.col("content"))), 100)
    want = P.fragments(text.splitlines(), [(i, i + 1) for i in range(1, 80, 2)], 100)
    got = sorted((r.diff_id, r.part, r.parts, r.content) for r in out.collect())
    assert len(want) > 1 and got == sorted([(i, 0, 1, "x") for i in (0, 3, 6)] + [(i, n, len(want), t) for i in (1, 2, 4, 5) for n, t in enumerate(want)])


def test_ranges_split_a_text_once(spark):
    df = spark.createDataFrame([("def a():\n  x\n# c\n}\ny\n",), ("",), (None,), (" a",)], "t string")
    out = df.select("t", N.indented_ranges(F.col("t")).alias("r"))
    assert {r.t: [tuple(x) for x in r.r] for r in out.collect()} == {"def a():\n  x\n# c\n}\ny\n": [(1, 4), (5, 5)], "": [], None: [], " a": []}
    assert _plan(out).count("split(") == 1
