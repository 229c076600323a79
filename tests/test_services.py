"""Staged model results, rule catalogues, access, registered layers, table sets, archives, the vector index and streams with state."""

import hashlib
import io
import random
import tarfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.operators import access as A
from riskloom.operators import matching
from riskloom.operators import review as R
from riskloom.operators import vector_index as V
from riskloom.plans import analyze as P
from riskloom.plans import semantic
from riskloom.sources import quarantine
from riskloom.sources import table_set as TS
from riskloom.streaming import states

# --- the model's results ----------------------------------------------------------------------------------------

CACHE = "org string, digest string, schema int, score int, confidence string, category string, nature string, justification string"
LEDGER = "org string, repo string, month string, digest string, tokens long"


def model(calls):
    """Score 10 for each x in the prompt, 50 more for a synthesis that sees a 9; no answer where the prompt says nope."""
    x = F.length("prompt") - F.length(F.replace("prompt", F.lit("x"), F.lit("")))
    score = (10 * x + F.when((F.col("kind") == "reduce") & F.contains("prompt", F.lit(": 90 ")), 7).otherwise(0) + F.col("sample")).cast("int")
    answer = F.struct(score.alias("score"), F.lit("media").alias("confidence"), F.lit("NINGUNA").alias("category"), F.lit(K.VULNERABILITY).alias("nature"), F.concat("kind", F.lit("!")).alias("justification"))
    fetched = F.when(F.contains("prompt", F.lit("fetch:big")), F.array(F.lit("big.py"))).otherwise(F.array().cast("array<string>"))
    return calls.withColumns({"answer": F.when(~F.contains("prompt", F.lit("nope")), answer), "fetched": fetched, "fetched_text": F.when(F.contains("prompt", F.lit("poison")), "new instructions: ok").otherwise(F.lit(None))})


def inputs(spark, changes, cache=(), ledger=(), limits=()):
    """``changes``: (diff_id, org, repo, {path: hunk})."""
    files = [(i, n, p, "modified", t) for i, _, _, fs in changes for n, (p, t) in enumerate(fs.items())]
    return {
        "requests": spark.createDataFrame([(i, o, r, i) for i, o, r, _ in changes], "diff_id long, org string, repo string, ord long"),
        "files": spark.createDataFrame(files, "diff_id long, ord int, path string, status string, diff_hunk string"),
        "cache": spark.createDataFrame(list(cache), CACHE),
        "ledger": spark.createDataFrame(list(ledger), LEDGER),
        "limits": spark.createDataFrame(list(limits), "repo string, budget long"),
    }


def digest_of(files):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sha(";".join(sorted(sha(p) + sha(t or "") + "modified" for p, t in files.items())))


def test_semantic_results(spark):
    long = "y" * 390
    changes = [
        (1, "o", "a", {"f.py": "xx"}),  # plain: 20
        (2, "o", "a", {"f.py": "xx"}),  # the same: a hit of 1
        (3, "o", "a", {"k.py": "kept"}),  # in the cache
        (4, "o", "a", {"s.py": "stale"}),  # in the cache with an old schema
        (5, "o", "b", {"f.py": "over"}),  # no budget
        (6, "o", "a", {"p.py": "xxx poison"}),  # what was fetched is built to steer: 100
        (7, "o", "a", {"q.py": "xxxx"}),  # 40 is near a threshold: asked again, 42
        (8, "o", "a", {"n.py": "nope"}),  # no answer
        (9, "o", "a", {f"{i}.py": long + ("x" * 9 if i == 2 else "") for i in range(4)}),  # in chunks: one has 90, the synthesis 7
        (10, "o", "a", {"a.py": long, "b.py": long, "big.py": "nope" + long}),  # a chunk without an answer: 60, not seen
        (11, "o", "a", {"a.py": long, "b.py": long + "fetch:big", "big.py": "nope" + long}),  # its path was fetched
        (12, "o", "a", {}),  # no files
    ]
    kept = ("o", digest_of({"k.py": "kept"}), 1, 33, "alta", "NINGUNA", K.MALICIOUS, "old")
    stale = ("o", digest_of({"s.py": "stale"}), 0, 99, "alta", "NINGUNA", K.MALICIOUS, "old")
    given = inputs(spark, changes, [kept, stale], [("o", "b", "2024-05", "d", 100), ("o", "a", "2024-05", "d", 5), ("o", "a", "2024-04", "d", 10**9)], [("b", 100), ("a", 10**6)])
    out = semantic.semantic_results(**given, evaluate=model, month="2024-05", max_tokens=110)
    got = {r.diff_id: r for r in out.results.collect()}
    assert {i: (r.status, r.score, r.skipped) for i, r in got.items()} == {
        1: ("single", 20, False), 2: ("hit", 20, False), 3: ("hit", 33, False), 4: ("single", 0, False), 5: ("budget", 0, True), 6: ("single", 100, False), 7: ("single", 42, False), 8: ("failed", 0, True),
        9: ("chunked", 90, False), 10: ("chunked", 60, False), 11: ("chunked", 0, False), 12: ("failed", 0, True),
    }
    assert (got[6].nature, got[6].category, got[10].nature) == (K.MALICIOUS, "OFUSCACION", K.UNCERTAIN)
    assert got[9].justification == "map! [synthesis: reduce!]" and got[1].digest == digest_of({"f.py": "xx"}) and got[12].digest == hashlib.sha256(b"").hexdigest()
    answers, usage = out.answers.collect(), out.usage.collect()
    assert len(answers) == 7 and {a.digest for a in answers} == {got[i].digest for i in (1, 4, 6, 7, 9, 10, 11)}
    assert {(u.repo, u.digest): u.tokens for u in usage} == {("a", got[i].digest): got[i].tokens for i in (1, 4, 6, 7, 9, 10, 11)}
    # a rerun over what was written adds nothing
    cache, ledger = semantic.with_answers(given["cache"], out.answers), semantic.with_usage(given["ledger"], out.usage)
    assert cache.count() == 8 and ledger.count() == 10
    again = semantic.semantic_results(**(given | {"cache": cache, "ledger": ledger}), evaluate=model, month="2024-05", max_tokens=110)
    assert again.answers.count() == again.usage.count() == 0
    second = {r.diff_id: (r.status, r.score) for r in again.results.collect()}
    assert second == {i: ("failed" if i in (8, 12) else "budget" if i == 5 else "hit", r.score) for i, r in got.items()}
    assert semantic.with_usage(ledger, out.usage).count() == ledger.count()


def test_budget_runs_out_within_a_batch(spark):
    changes = [(i, "o", "a", {"f.py": "x" * (400 + i)}) for i in range(6)] + [(6, "o", "a", {"f.py": "x" * 401})]
    got = semantic.semantic_results(**inputs(spark, changes, limits=[("a", 250)]), evaluate=model, month="m").results.collect()
    assert [r.status for r in sorted(got, key=lambda r: r.diff_id)] == ["single"] * 3 + ["budget"] * 4
    none = inputs(spark, [])
    assert semantic.semantic_results(**none, evaluate=model, month="m").results.count() == 0


# --- rules ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_text_rule_hits_of_many_rules(spark, part_bytes):
    r = random.Random(3)
    word = lambda n=6: "".join(r.choice("abAB \"") for _ in range(r.randint(1, n)))
    texts = [(i, word(40)) for i in range(40)] + [(40, None), (41, ""), (41, "ab")]
    rules = []
    for k in range(30):
        strings = [(word(3), r.random() < 0.5) for _ in range(r.randint(1, 4))] + ([("", False)] if k == 7 else [])
        rules.append((f"r{k}", strings, r.randint(1, len(strings)), k))
    df = spark.createDataFrame(rules, "rule_id string, strings array<struct<text: string, nocase: boolean>>, needed int, score int")
    got = sorted(tuple(x) for x in R.text_rule_hits(spark.createDataFrame(texts, "id int, t string"), df, ["id"], "t", part_bytes).collect())
    holds = lambda t, s: s[0].lower() in t.lower() if s[1] else s[0] in t
    assert got == sorted((i, n, score) for i, t in texts for n, strings, needed, score in rules if sum(holds(t or "", s) for s in strings) >= needed)


def test_the_plan_does_not_grow_with_the_rules(spark):
    rule = lambda k: (f"r{k}", [(f"<{k}>", False)], 1, 60)
    kind = "rule_id string, strings array<struct<text: string, nocase: boolean>>, needed int, score int"
    texts = spark.createDataFrame([(1, "<4999> and <17>")], "id int, t string")
    plans = []
    for n in (10, 20_000):
        hits = R.text_rule_hits(texts, spark.createDataFrame([rule(k) for k in range(n)], kind), ["id"], "t")
        plans.append(len(hits._jdf.queryExecution().toString()))
    assert abs(plans[1] - plans[0]) < 200
    assert sorted(x.rule_id for x in hits.collect()) == ["r17", "r4999"]


def test_decided_rules(spark):
    rule = lambda n: f'rule {n} {{ strings: $a = "x" condition: any of them }}'
    stored = [("abc", "web", rule("abc"), "why", "pending"), ("bad", "web", rule("other"), "why", "pending"), ("done", "web", rule("done"), "why", "approved"), ("left", "web", rule("left"), "why", "pending")]
    log = [("abc", 1, "approve", "eve", "t1"), ("abc", 2, "reject", " ROOT", "t2"), ("abc", 3, "approve", "root", "t3"), ("bad", 1, "approve", "root", "t1"), ("bad", 2, "reject", "root", "t2"), ("done", 1, "reject", "root", "t1"), ("none", 1, "approve", "root", "t1")]
    df = spark.createDataFrame(stored, "rule_name string, category string, source string, rationale string, status string")
    out = R.decided_rules(df, spark.createDataFrame(log, "rule_name string, ord int, action string, reviewer string, at string"), [" Root", ""])
    assert {r.rule_name: (r.status, r.reviewed_by, r.reviewed_at) for r in out.collect()} == {"abc": ("rejected", "root", "t2"), "bad": ("rejected", "root", "t2"), "done": ("approved", None, None), "left": ("pending", None, None)}
    assert [r.source for r in R.approved_rules(df).collect()] == [rule("done")]


# --- access -----------------------------------------------------------------------------------------------------


def test_block_list(spark):
    old = spark.createDataFrame([("o", "ann", "r0", "x", 0), ("o", "bob", "r0", "x", 0)], "org_id string, author_login string, reason string, blocked_by string, blocked_at int")
    log = [("o", 1, "add", " ann ", "r1", "me", 1), ("o", 2, "remove", "bob", None, "me", 2), ("o", 3, "add", "bob", " r3 ", "me", 3), ("o", 4, "remove", "ann", None, "me", 4), ("o", 5, "remove", "ann", None, "me", 5), ("p", 6, "add", "ann", None, "me", 6), ("o", 7, "add", " ", "r", "me", 7), ("o", 8, "add", "cem", "a", "me", 8), ("o", 9, "add", "cem", "b", "me", 9)]
    now, refused = A.block_list(old, spark.createDataFrame(log, "org_id string, ord int, action string, author_login string, reason string, by string, at int"))
    assert sorted(map(tuple, now.collect())) == [("o", "bob", "r3", "me", 3), ("o", "cem", "a", "me", 8), ("p", "ann", "", "me", 6)]
    assert sorted((r.ord, r.why) for r in refused.collect()) == [(1, "present"), (5, "absent"), (7, "empty"), (9, "present")]
    assert [r.author_login for r in A.newest_blocked(now, F.lit("o")).collect()] == ["cem", "bob"]


def test_small_expressions(spark):
    cases = [('{"official_registry_configs": ["p/a", "x/b", "r/c-1", 3, null, "p/../z"]}', "a/b c.d", " v1/2 ", "90"), ("not json", "", "", "x"), ('{"official_registry_configs": {"p/a": 1}}', None, None, None)]
    rows = spark.createDataFrame(cases, "m string, j string, v string, t string")
    got = rows.select(A.safe_registry_ids(F.col("m")).alias("ids"), A.job_part(F.col("j")).alias("j"), A.path_version(F.col("v")).alias("v"), A.ttl_seconds(F.col("t"), 60).alias("t")).collect()
    assert [tuple(r) for r in got] == [(["p/a", "r/c-1"], "a_b_c_d", "v1_2", 90), ([], "", "unknown", 60), ([], None, "unknown", 60)]
    outcomes = spark.createDataFrame([(1, i, i, i == 3) for i in range(9)] + [(2, 0, 7, False)], "id int, ord int, at int, success boolean")
    monitored = spark.createDataFrame([(1, None, 2, "active"), (2, 1, 3, "active"), (3, 1, 4, "active")], "id int, last_polled_at int, consecutive_errors int, status string")
    assert sorted(map(tuple, A.poll_outcomes(monitored, outcomes).collect())) == [(1, 8, 5, "error"), (2, 7, 4, "active"), (3, 1, 4, "active")]
    cases = spark.createDataFrame([("a-1", "T"), ("../x", "S")], "case_id string, title string")
    assert [r.case_id for r in A.case_listing(cases).collect()] == ["../x", "a-1"]
    assert A.case_detail(cases, "../x").count() == 0 and A.case_detail(cases, "a-1").count() == 1


# --- layers -----------------------------------------------------------------------------------------------------


def test_a_registered_layer_counts(spark):
    diff = "diff --git a/run.py b/run.py\n--- a/run.py\n+++ b/run.py\n@@ -1 +1 @@\n+plain\n"
    diffs = spark.createDataFrame([(1, diff), (2, diff)], "diff_id int, diff string")
    empty = {"reference": spark.createDataFrame([], "ecosystem string, ord int, name string"), "advisories": spark.createDataFrame([], "ecosystem string, name string, version string, vulns array<struct<id: string, summary: string, severity: array<struct<type: string, score: string>>, nominal: array<string>, cvss: string>>"), "reputation": spark.createDataFrame([], "diff_id int, account_age_days int")}

    @P.layer("odd")
    def odd(x):
        score = F.when(F.col("diff_id") % 2 == 1, 100).otherwise(0)
        return P._layer(x.ids, "odd", score=score, confidence=F.lit(K.HIGH), nature=F.lit(K.UNCERTAIN), category=F.lit("NINGUNA"), justification=F.lit("")), None

    try:
        weights = {"static": 0.5, "odd": 0.5}
        got = {r.diff_id: (r.score, r.weights["odd"]) for r in P.analyze(diffs, **empty, config=P.Config(weights)).results.collect()}
        assert got == {1: (50, 0.5), 2: (0, 0.5)}
        even = lambda x: (odd(x)[0].withColumn("score", 100 - F.col("score")), None)
        assert {r.diff_id: r.score for r in P.analyze(diffs, **empty, config=P.Config(weights), layers={"odd": even}).results.collect()} == {1: 0, 2: 50}
    finally:
        del P.REGISTRY["odd"]


# --- table sets -------------------------------------------------------------------------------------------------


def test_table_set(spark, tmp_path):
    base = f"file://{tmp_path}/set"
    rows = lambda *repos: spark.createDataFrame([(r, i) for i, r in enumerate(repos)], "repo string, id int")
    tables = TS.TableSet(spark, base).commit({"scores": rows("a", "b"), "roles": rows("a", "c").withColumn("user_login", F.lit("Ann ")), "blocked_authors": rows("a"), "users": spark.createDataFrame([("ann",), ("bob",)], "user_login string")})
    gone = spark.createDataFrame([("a",)], "repo string")

    def breaks(name):
        raise RuntimeError(name)

    with pytest.raises(RuntimeError):
        tables.commit(TS.without_repos(tables, gone), after_write=breaks)
    still = TS.TableSet(spark, base)
    assert still.version == 1 and still.read("scores").count() == 2 and len(still.unused()) == 1
    after = tables.commit(TS.without_repos(tables, gone))
    assert after.version == 2 and [r.repo for r in after.read("scores").collect()] == ["b"] and after.read("roles").count() == 1 and after.read("blocked_authors").count() == 1
    assert tables.read("scores").count() == 2  # a reader keeps its version
    with pytest.raises(TS.Conflict):
        tables.commit({"scores": rows("z")})
    assert TS.TableSet(spark, base).version == 2
    last = after.commit(TS.without_users(after, spark.createDataFrame([("ANN",)], "user_login string")))
    assert [r.user_login for r in last.read("users").collect()] == ["bob"] and last.read("roles").count() == 0


# --- archives and bad records -----------------------------------------------------------------------------------


def tar(files, mode="w:gz"):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode=mode) as t:
        for name, data in files:
            m = tarfile.TarInfo(name)
            if data is None:
                m.type = tarfile.DIRTYPE
                t.addfile(m)
            else:
                m.size = len(data)
                t.addfile(m, io.BytesIO(data))
    return held.getvalue()


def test_archives(spark, tmp_path):
    good = [("a/b.py", b"x\n"), ("a", None), ("../up", b"u"), ("/abs", b"u"), ("bin", b"\xff\xfe"), ("big", b"b" * 50), ("", b"e"), ("é.txt", "ñ".encode())]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.tar.gz").write_bytes(tar(good))
    (tmp_path / "in" / "p.tar").write_bytes(tar([("p", b"1")], "w"))
    (tmp_path / "in" / "cut.tar.gz").write_bytes(tar([("one", b"1" * 3000), ("two", random.Random(1).randbytes(9000))])[:4000])
    none = spark.createDataFrame([(1, bytearray()), (2, None), (3, bytearray(b"no archive"))], "archive int, content binary")
    assert sorted((r.archive, r.path, r.reason) for r in quarantine.archive_files(none).collect()) == [(i, "", "broken") for i in (1, 2, 3)]
    got = sorted((r.archive.rsplit("/", 1)[1], r.path, r.text, r.reason) for r in quarantine.read_archives(spark, str(tmp_path / "in"), most=3000).collect())
    assert [g for g in got if g[0] == "g.tar.gz" and g[1]] == sorted([("g.tar.gz", "../up", None, "unsafe_path"), ("g.tar.gz", "/abs", None, "unsafe_path"), ("g.tar.gz", "a/b.py", "x\n", None), ("g.tar.gz", "big", "b" * 50, None), ("g.tar.gz", "bin", None, "not_utf8"), ("g.tar.gz", "é.txt", "ñ", None)])
    assert ("p.tar", "p", "1", None) in got and ("cut.tar.gz", "", None, "broken") in got
    quarantine.register_functions(spark)
    rows = spark.createDataFrame([(1, bytearray(tar(good)))], "id int, data binary")
    assert spark.sql("SELECT m.path FROM {rows}, LATERAL archive_members(data) m WHERE m.reason IS NULL", rows=rows).count() == len([g for g in got if g[0] == "g.tar.gz" and g[3] is None])


def test_quarantine(spark, tmp_path):
    rows = [(1, b"ok"), (2, b"\xc3"), (3, None), (4, b""), (5, b"x" * 11), (6, "é".encode())]
    good, bad = quarantine.split(spark.createDataFrame([(i, d and bytearray(d)) for i, d in rows], "id int, content binary"), ["id"], most=10)
    assert sorted((r.id, r.text) for r in good.collect()) == [(1, "ok"), (4, ""), (6, "é")] or sorted((r.id, r.text) for r in good.collect()) == [(1, "ok"), (6, "é")]
    assert good.count() + bad.count() == len(rows)
    assert {(r.id, r.reason) for r in bad.collect()} >= {(2, "not_utf8"), (3, "missing"), (5, "too_large")}
    (tmp_path / "f").mkdir()
    for n, d in (("a", b"ok"), ("b", b"\xff"), ("c", b"y" * 20)):
        (tmp_path / "f" / n).write_bytes(d)
    good, bad = quarantine.read_files(spark, str(tmp_path / "f"), most=10)
    assert [r.text for r in good.collect()] == ["ok"] and sorted((r.n_bytes, r.reason) for r in bad.collect()) == [(1, "not_utf8"), (20, "too_large")]


# --- the vector index -------------------------------------------------------------------------------------------


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16))
    vectors = [(i, (middle[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(2000, None), (2001, [0.0] * 16), (2002, [None] * 16)] + [(3000 + i, middle[0].tolist()) for i in range(40)] + [(7, middle[1].tolist())]
    items = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    index = V.rebuild(spark, items, f"file://{tmp_path}/index", sample_rows=300)
    assert index.read("items").count() == 1541 and index.read("centres").agg(F.sum("n")).first()[0] == 1541
    queries = items.filter("vec_id % 50 = 0 OR vec_id > 1999 AND vec_id < 3001")
    clean = items.filter("vec_id NOT BETWEEN 2000 AND 2002")
    exact = matching.top_k(queries.filter("vec_id NOT BETWEEN 2000 AND 2002"), clean, 10)
    all_cells = V.search(index, queries, 10, V.MOST_CELLS, block=7)
    key = lambda df: sorted((r.query, r["rank"], round(r.distance, 9)) for r in df.select("query", "rank", "distance").collect())
    assert key(all_cells) == key(exact)
    share = V.recall(V.search(index, queries, 10, 6), exact, 10).first()
    assert share.n_queries == queries.count() - 3 and share.recall >= 0.9
    again = V.rebuild(spark, items.filter("vec_id < 100"), f"file://{tmp_path}/index")
    assert (again.version, again.read("items").count(), index.read("items").count()) == (2, 101, 1541)
    assert V.search(again, queries.limit(0), 5, 3).count() == 0
    assert V.search(V.rebuild(spark, items.limit(0), f"file://{tmp_path}/none"), queries, 5, 3).count() == 0


# --- streams ----------------------------------------------------------------------------------------------------


def run_stream(spark, out, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), q


def stream_of(spark, tmp_path, batches, schema):
    """A stream of files, one a batch."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.fixture
def rocksdb(spark):
    states.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_build_states(spark, tmp_path, rocksdb):
    at = lambda s: f"2024-01-01 {s}"
    batches = [
        [("a", at("00:00:00"), 1, "request", None), ("a", at("00:00:10"), 2, "start", None), ("b", at("00:00:00"), 3, "done", None), ("c", at("00:01:00"), 4, "start", None)],
        [("a", at("00:00:20"), 5, "request", None), ("a", at("00:00:30"), 6, "fail", "x" * 600), ("a", at("00:00:05"), 7, "start", None), ("a", at("00:00:40"), 8, "request", None)],
        [("d", at("04:00:00"), 9, "request", None)],
        [("e", at("09:00:00"), 10, "request", None), ("a", at("00:00:50"), 11, "start", None)],
        [("a", at("15:00:00"), 12, "done", None), ("c", at("15:00:00"), 13, "request", None), ("f", at("20:00:00"), 14, "request", None)],
        [("f", at("23:00:00"), 15, "start", None), ("f", at("23:40:00"), 16, "done", None)],
    ]
    stream = stream_of(spark, tmp_path, batches, "repo string, ts string, ord long, kind string, message string")
    rows, q = run_stream(spark, states.build_states(stream, stale=1800, ttl=7200), tmp_path, "builds")
    got = sorted((r.repo, r.ts.strftime("%H:%M:%S"), r.status, len(r.error or "")) for r in rows.collect())
    assert [g for g in got if g[0] == "a"][:4] == [("a", "00:00:00", "pending", 0), ("a", "00:00:10", "building", 0), ("a", "00:00:30", "error", 500), ("a", "00:00:40", "pending", 0)]
    assert not [g for g in got if g[0] == "b"]  # an end without a build changes nothing
    assert [g for g in got if g[0] == "c"] == [("c", "00:01:00", "building", 0), ("c", "00:31:00", "error", len(states.TIMED_OUT)), ("c", "15:00:00", "pending", 0)]
    assert [g[1:3] for g in got if g[0] == "f"] == [("20:00:00", "pending"), ("23:00:00", "building"), ("23:30:00", "error")]  # stale by its own events
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept[-1] <= 6  # idle repositories are forgotten


def test_sessions_drop_late_rows(spark, tmp_path):
    at = lambda s: f"2024-01-01 {s}"
    stream = stream_of(spark, tmp_path, [[("u", at("00:00:00")), ("u", at("00:20:00")), ("v", at("00:00:00"))], [("w", at("06:00:00"))], [("w", at("06:00:00"))], [("u", at("00:25:00")), ("w", at("12:00:00"))]], "user string, ts string")
    rows, _ = run_stream(spark, states.sessions(stream, "user", "30 minutes"), tmp_path, "sessions")
    assert sorted((r.user, r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.n) for r in rows.collect()) == [("u", "00:00", "00:50", 2), ("v", "00:00", "00:30", 1), ("w", "06:00", "06:30", 2)]


def test_followed_by(spark, tmp_path):
    at = lambda s: f"2024-01-01 {s}"
    rows = [[("u", 1, at("00:00:00"), "a"), ("u", 2, at("00:30:00"), "b"), ("u", 3, at("00:00:00"), "b"), ("v", 4, at("00:00:00"), "a")], [("x", 5, at("09:00:00"), "a"), ("x", 6, at("09:00:00"), "b")], [("x", 11, at("09:00:00"), "b")], [("v", 7, at("00:10:00"), "b"), ("x", 8, at("09:50:00"), "b")], [("y", 9, at("20:00:00"), "a"), ("y", 10, at("20:00:00"), "b")]]
    stream = stream_of(spark, tmp_path, rows, "user string, id long, ts string, kind string")
    out, _ = run_stream(spark, states.followed_by(stream.filter("kind = 'a'"), stream.filter("kind = 'b'"), "user"), tmp_path, "pairs")
    assert sorted((r.user, r.id, r.next_id) for r in out.filter("id <> 9").collect()) == [("u", 1, 2), ("v", 4, None), ("x", 5, 8)]


# --- what is shown, packed, linked and ranked -------------------------------------------------------------------


def test_excerpt(spark):
    def brute(lines, matches):
        stretches = []
        for m in matches:
            a, z = max(0, m - 3), min(len(lines), m + 4)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], z)
            else:
                stretches.append([a, z])
        out, used = [], 0
        for a, z in stretches:
            if used >= 60:
                break
            out.append("\n".join(lines[a:z]))
            used += z - a
        return "\n[...]\n".join(out)

    r = random.Random(5)
    cases = []
    for n in (1, 5, 30, 300):
        for k in (0, 1, 4, 25):
            cases.append((n, [f"l{i}" for i in range(n)], sorted(r.sample(range(n), min(k, n)))))
    rows = spark.createDataFrame([(i, "\n".join(lines), m) for i, (_, lines, m) in enumerate(cases)], "id int, t string, m array<int>")
    got = {x.id: x.e for x in rows.select("id", R.excerpt(F.col("t"), F.col("m")).alias("e")).collect()}
    assert all(got[i] == brute(lines, m) for i, (_, lines, m) in enumerate(cases))


def test_rendered_files_show_what_was_not_read(spark):
    files = [("a.py", "added", "+eval(x)", "whole"), ("b.py", "modified", "+x\n+eval(y)\n" + "+z\n" * 90, "excerpt"), ("c.py", "added", "+x", "unverified"), ("d.py", None, None, "no_budget")]
    out = R.rendered(spark.createDataFrame(files, "path string, status string, diff_hunk string, form string"))
    assert out.filter("text IS NULL").count() == 0
    whole = out.agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("t")).select(R.unverified_paths(F.col("t")).alias("p")).first().p
    assert sorted(whole) == ["c.py", "d.py"]


def test_pack_pieces_of_many_changes(spark):
    from riskloom.operators import packing

    r = random.Random(9)
    pieces, edges = [], []
    for g in range(60):
        for i in range(r.randint(1, 12)):
            pieces.append((g if g else None, i, f"f{r.randint(0, 5)}", i, r.randint(1, 90)))
        edges += [(g, f"f{r.randint(0, 5)}", f"f{r.randint(0, 5)}") for _ in range(r.randint(0, 4))]
    df = spark.createDataFrame(pieces, "diff_id int, ord int, path string, part int, tokens int")
    got = {(x.diff_id, x.part): x.chunk for x in packing.pack_pieces(df, spark.createDataFrame(edges, "diff_id int, a string, b string"), budget=100, most=4).collect()}
    for g in {p[0] for p in pieces}:
        near = {}
        for e, a, b in edges:
            if e == g:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        chunks = []
        for _, _, path, part, tokens in sorted((p for p in pieces if p[0] == g), key=lambda p: (-len(near.get(p[2], ())), p[1])):
            room = [i for i, (used, _) in enumerate(chunks) if used + tokens <= 100]
            at = next((i for i in room if near.get(path, set()) & chunks[i][1]), room[0] if room else None)
            if at is None and len(chunks) < 4:
                at = len(chunks)
                chunks.append([0, set()])
            if at is not None:
                chunks[at][0] += tokens
                chunks[at][1].add(path)
            assert got[g, part] == at


def test_numbered_and_classes(spark):
    from riskloom.operators import history

    rows = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"), F.lit("x").alias("v"))
    assert sorted((r.k, r.place) for r in history.numbered(rows, "k").collect()) == [(i, i + 1) for i in range(500)]
    assert history.numbered(rows.limit(0), "k").count() == 0
    lit = spark.createDataFrame([(1, i, "hot") for i in range(50)] + [(1, 3, "u"), (1, 3, "u"), (2, 4, "hot"), (1, 7, "two"), (1, 9, "two")], "g int, n int, literal string")
    got = matching.literal_classes(lit, "g", "n").collect()
    assert len(got) == 52 and {(r.literal, r.size, r.first) for r in got} == {("hot", 50, 0), ("two", 2, 7)}


def test_rule_hits_in_parts(spark):
    texts = spark.createDataFrame([(1, "abc", "python"), (2, "ABC", "go"), (3, None, "go")], "id int, t string, language string")
    rules = spark.createDataFrame([("a", "b", 10, None, None), ("b", "(?i)b", 20, K.MALICIOUS, "go"), ("c", "z", 30, None, None)], "rule_id string, pattern string, score int, nature string, language string")
    for most in (1, 200):
        assert sorted(map(str, map(tuple, matching.rule_hits(texts, rules, ["id"], "t", most).collect()))) == sorted(map(str, [(1, "a", 10, None), (2, "b", 20, K.MALICIOUS)]))
    assert matching.rule_hits(texts, rules.limit(0), ["id"], "t").count() == 0


def test_a_layer_that_fails_leaves_the_others(spark):
    diff = "diff --git a/run.py b/run.py\n--- a/run.py\n+++ b/run.py\n@@ -1 +1 @@\n+eval(x)\n"
    diffs = spark.createDataFrame([(1, diff)], "diff_id int, diff string")
    none = {"reference": spark.createDataFrame([], "ecosystem string, ord int, name string"), "advisories": spark.createDataFrame([], "ecosystem string, name string, version string, vulns array<struct<id: string, summary: string, severity: array<struct<type: string, score: string>>, nominal: array<string>, cvss: string>>"), "reputation": spark.createDataFrame([], "diff_id int, account_age_days int")}

    def plans_badly(x):
        raise ValueError("no plan")

    def runs_badly(x):
        return P._layer(x.ids, "late", score=F.raise_error(F.lit("no run")).cast("int")), None

    got = P.analyze(diffs, **none, config=P.Config({"static": 0.5, "early": 0.3, "late": 0.2}, isolate=True), layers={"early": plans_badly, "late": runs_badly})
    assert {r.layer: (r.score, r.skipped, r.crashed) for r in got.layers.collect()} == {"static": (90, False, False), "early": (0, True, True), "late": (0, True, True)}
    assert [r.score for r in got.results.collect()] == [90]


def test_views(spark):
    from riskloom.plans import views

    diff = "diff --git a/requirements.txt b/requirements.txt\n--- a/requirements.txt\n+++ b/requirements.txt\n@@ -1 +1,2 @@\n+requests==1.0\n+# eval(x) https://host.example/abc\n"
    spark.createDataFrame([(1, diff)], "diff_id int, diff string").createOrReplaceTempView("some_diffs")
    assert views.register(spark, diffs_view="some_diffs", prefix="v_") == ["v_file_changes", "v_dependency_changes", "v_suspicious_lines", "v_notable_literals"]
    assert [r.name for r in spark.sql("SELECT name FROM v_dependency_changes WHERE ecosystem = 'PyPI'").collect()] == ["requests"]
    both = spark.sql("SELECT f.path, s.label, l.literal FROM v_file_changes f JOIN v_suspicious_lines s USING (diff_id, ord) JOIN v_notable_literals l USING (diff_id, ord)").collect()
    assert [tuple(r) for r in both] == [("requirements.txt", "eval_dynamic", "https://host.example/abc")]


def test_users_meet_repositories_without_a_shuffle_of_their_pairs(spark, monkeypatch):
    """A user of two organisations that share a repository has it once; nothing that has a row for each pair is shuffled."""
    users = spark.createDataFrame([("ann", "a"), ("ann", "b"), ("ann", "b"), ("bob", "b"), ("eve", None), (" Root", "a"), ("root", None)], "user_login string, org_id string")
    monitored = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "b"), ("r2", "b"), ("r3", "c")], "repo string, org_id string")
    monkeypatch.setattr("riskloom.functions.staging.LIST_ROWS", 1)
    out = A.admin_scope(users, monitored, "root")
    want = [("ann", "r1"), ("ann", "r2"), ("bob", "r1"), ("bob", "r2"), ("root", "r1"), ("root", "r2"), ("root", "r3")]
    assert sorted(tuple(r) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")  # no distinct over the pairs


def test_scope_of_one_large_organisation_is_made_by_all_tasks(spark, monkeypatch):
    """All users and repositories in one organisation: one key of the join, of few bytes, whose pairs are still dealt."""
    monkeypatch.setattr("riskloom.functions.staging.LIST_ROWS", 10)
    users = spark.range(300).select(F.concat(F.lit("u"), F.col("id")).alias("user_login"), F.lit("a").alias("org_id"))
    monitored = spark.range(200).select(F.concat(F.lit("r"), F.col("id")).alias("repo"), F.lit("a").alias("org_id"))
    for broadcast in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            out = A.admin_scope(users.unionByName(users), monitored.unionByName(monitored), "root")
            got = [tuple(r) for r in out.select("user_login", "repo", F.spark_partition_id()).collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(r[:2] for r in got) == sorted((f"u{u}", f"r{r}") for u in range(300) for r in range(200))
        per_task = Counter(r[2] for r in got)
        assert len(per_task) >= 4 and max(per_task.values()) < len(got) / 2


def test_rules_with_the_same_strings_are_one_class(spark):
    """Rules of equal strings come back after the search, also under one name twice, with their own scores."""
    rules = [(f"r{k % 40}", [("ab", False)], 1, k % 2) for k in range(50)] + [("s", [("ab", True)], 1, 7), ("t", [("ab", False), ("zz", False)], 2, 8)]
    df = spark.createDataFrame(rules, "rule_id string, strings array<struct<text: string, nocase: boolean>>, needed int, score int")
    hits = R.text_rule_hits(spark.createDataFrame([(1, "xabx"), (2, "AB"), (3, "abzz"), (4, "")], "id int, t string"), df, ["id"], "t")
    holds = lambda t, s: s[0] in t.lower() if s[1] else s[0] in t
    want = sorted((i, n, score) for i, t in ((1, "xabx"), (2, "AB"), (3, "abzz")) for n, strings, needed, score in rules if sum(holds(t, s) for s in strings) >= needed)
    assert sorted(tuple(r) for r in hits.collect()) == want
    assert "Generate explode" in hits._jdf.queryExecution().executedPlan().toString()


def test_rules_of_one_class_hit_in_all_tasks(spark, monkeypatch):
    """Rules with equal strings that all texts have, out of one partition each: all tasks read rules and make the pairs."""
    monkeypatch.setattr("riskloom.functions.staging.LIST_ROWS", 10)
    source = F.concat(F.lit("rule r"), F.col("id"), F.lit(' {\n  strings: $a = "ab"\n  condition: any of them\n}'))
    rules = R.text_rules(spark.range(0, 200, 1, 1).select(F.lit("web").alias("category"), source.alias("source")))
    tasks = {r[0] for r in rules.select(F.spark_partition_id()).collect()}
    assert len(tasks) >= 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = R.text_rule_hits(spark.range(0, 150, 1, 1).select("id", F.lit("xabx").alias("t")), rules, ["id"], "t")
        got = [tuple(r) for r in hits.select("id", "rule_id", "score", F.spark_partition_id()).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r[:3] for r in got) == sorted((i, f"web.r{k}", K.DEFAULT_RULE_SCORE) for i in range(150) for k in range(200))
    per_task = Counter(r[3] for r in got)
    assert len(per_task) >= 4 and max(per_task.values()) < len(got) / 2


def test_top_k_of_ties_and_vectors_without_a_direction(spark, monkeypatch):
    """Exact distances added in order, ties by id, over several blocks of items and queries; no direction comes last."""
    monkeypatch.setattr(matching, "ITEM_BLOCK", 7)
    r = random.Random(5)
    base = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    vectors = [base[k % 12] for k in range(60)] + [[0.0] * 6, None, [1.0, None, 0.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(k, v, k % 3) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3)

    def distance(a, b):
        if None in (a, b) or None in (*a, *b) or not any(a) or not any(b):
            return float("inf")
        a, b = ([float(np.float32(x)) for x in v] for v in (a, b))
        dot = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
        total = [0.0, 0.0, 0.0]
        for p, q in zip(a, b):
            total = [total[0] + p * q, total[1] + p * p, total[2] + q * q]
        return 1 - total[0] / (total[1] ** 0.5 * total[2] ** 0.5)

    for block in (1024, 4):
        for k in (4, 61):
            got = sorted(tuple(x) for x in matching.top_k(df.filter("vec_id % 5 = 0"), df, k, keep=["label"], block=block).select("query", "rank", "id", "label").collect())
            want = []
            for q in range(0, len(vectors), 5):
                order = sorted(range(len(vectors)), key=lambda i: (distance(vectors[q], vectors[i]), i))[:k]
                want += [(q, n + 1, i, i % 3) for n, i in enumerate(order)]
            assert got == want
    assert matching.top_k(df.limit(0), df, 3).count() == 0
    assert matching.top_k(df, df.limit(0), 3).count() == 0
    plan = matching.top_k(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
