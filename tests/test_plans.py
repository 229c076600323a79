"""Whole plans and streams."""

import json

from pyspark.sql import functions as F

import __spark_entry__
from riskloom.operators import history as H
from riskloom.operators import packing as P
from riskloom.operators import render
from riskloom.plans import queries as Q
from riskloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_agent_metrics_without_rows(spark):
    s, u = spark.createDataFrame([], "agent string, score int"), spark.createDataFrame([], "user_id string, tokens_used long")
    assert [tuple(r) for r in H.agent_metrics(s, u).collect()] == [("default-agent", 0, 0.0, 0)]


def test_pack_pieces(spark):
    pieces = spark.createDataFrame([("d", i, f"f{i}", 1, 400) for i in range(50)], "diff_id string, ord int, path string, part int, tokens int")
    edges = spark.createDataFrame([("d", "f0", "f49")], "diff_id string, a string, b string")
    got = P.pack_pieces(pieces, edges, budget=1000, most=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk, []).append(r)
    assert {r.path for r in by[0]} == {"f0", "f49"}
    assert len(by[None]) == 10 and all(sum(x.tokens for x in v) <= 1000 for k, v in by.items() if k is not None) and len(by) == 21


def test_reports(spark):
    a = Q._analysis(spark, SF)
    docs = [json.loads(r.sarif) for r in render.sarif(a.results, a.layers, a.findings).collect()]
    assert all(d["version"] == "2.1.0" for d in docs)
    assert any(x["ruleId"].startswith("static.suspicious") for d in docs for x in d["runs"][0]["results"])
    comments = {r.diff_id: r.comment for r in render.comments(a.results, a.layers).collect()}
    bad = {r.diff_id for r in a.results.filter("malicious > 0").collect()}
    assert bad and all(("withheld" in comments[i]) == (i in bad) for i in comments)
    flat = render.flat_score_rows(a.results.select("diff_id", "score"), a.layers.filter("layer <> 'semantic'")).first()
    assert flat.semantic_skipped is True and flat.semantic_score is None


def test_rate_limit_does_not_record_rejections(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 3, 59)] + [("a", "2024-01-01 00:01:01"), ("b", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    jobs.sliding_limit(stream, "k", 2, 60).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, str(r.ts)[14:]): r.allowed for r in spark.table("limits").collect()}
    assert [got["a", t] for t in ("00:00", "00:01", "00:02", "00:03", "00:59", "01:01")] == [True, True, False, False, False, True]


def test_top_k_in_blocks(spark):
    from riskloom.operators import matching

    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.select("query", "id", "rank").collect())
    q = e.filter("vec_id % 10 = 0")
    blocks = matching.top_k(q, e, 5, block=7)
    assert rows(blocks) == rows(matching.top_k(q, e, 5)) and len(rows(blocks)) == 5 * q.count()
    got = Q.QUERIES["vector_top_k_full"](spark, SF)
    assert {r["query"] for r in got.collect()} == {r.vec_id for r in e.filter("vec_id % 100 = 0").collect()}


def test_prior_risk_of_all_changes(spark):
    s = Q.scores(spark, SF).collect()
    risky = {}
    for r in s:
        if r.score >= 70:
            risky.setdefault(r.author, set()).add((r.repo, r.pr_number))
    want = sorted(r.event_id for r in s if risky.get(r.author, set()) - {(r.repo, r.pr_number)})
    assert sorted(r.event_id for r in Q.QUERIES["prior_risk_authors_full"](spark, SF).collect()) == want
    assert any(r.score >= 10 and r.event_id in set(want) for r in s)


def test_cache_and_block_list_of_all_rows(spark):
    plan = Q.QUERIES["cache_plan_full"](spark, SF).collect()
    assert {r.source for r in plan} == {"cache", "fetch", "limit"} and max(r.ord for r in plan if r.source == "cache") >= 900
    more = "/root/testdata/sf0.01"  # the smallest tables have 15 users
    blocked = {int(r.author[1:]) for r in Q.QUERIES["blocked_changes_full"](spark, more).select("author").distinct().collect()}
    users = {r.user_id for r in Q.table(spark, more, "events").select("user_id").distinct().collect()}
    assert max(blocked) >= 40 and blocked < users


def test_every_row_has_a_role(spark):
    fixed = Q.QUERIES["verify_fix_full"](spark, SF).groupBy("status").count().collect()
    odd = Q.table(spark, SF, "lineitem").filter("l_orderkey % 2 = 1").count()
    assert {r.status: r["count"] for r in fixed}["remaining"] == odd and len(fixed) == 2
    parts = [(r.p_partkey, f"{r.p_name} {r.p_brand} {r.p_size}") for r in Q.table(spark, SF, "part").collect()]
    want = {n for k, n in parts if k % 2} - {n for k, n in parts if k % 2 == 0}
    assert {r.p_name for r in Q.QUERIES["insert_unseen_rules_full"](spark, SF).collect()} == want != set()
    found = Q.QUERIES["lookalike_packages_full"](spark, SF).select("looks_like").distinct().collect()
    listed = {r.p_name for r in Q.table(spark, SF, "part").filter("p_partkey % 3 = 0").collect()}
    assert {r.looks_like for r in found} - listed


def test_streams_of_a_folder(spark, tmp_path):
    names = ("stream_monthly_tokens", "stream_daily_counts", "stream_rate_limit", "stream_quota")
    events = Q.table(spark, SF, "events")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    for name in names:
        got, want = Q.QUERIES[name](spark, str(tmp_path)), Q.QUERIES[name](spark, SF)
        assert rows(got) == rows(want) != [] and got.inputFiles()
    assert Q.QUERIES["stream_quota"](spark, str(tmp_path)).count() == events.count()
    empty = tmp_path / "none"
    events.limit(0).write.parquet(str(empty / "events.parquet"))
    assert [Q.QUERIES[n](spark, str(empty)).count() for n in names] == [0, 0, 0, 0]


def test_consecutive_errors(spark):
    polls = spark.createDataFrame([("r", i, i == 2) for i in range(8)] + [("s", 0, False)], "repo string, ts int, ok boolean")
    assert {(r.repo, r.errors, r.status) for r in H.consecutive_errors(polls).collect()} == {("r", 5, "error"), ("s", 1, "ok")}
