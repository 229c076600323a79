"""Reviews, proposed rules, stored graphs, settings."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.operators import review as R
from riskloom.sources import config as C


def _ranges(spark, code):
    rows = spark.createDataFrame([(code,)], "t string").select(R.brace_ranges(F.col("t")).alias("r"))
    return [(x["start"], x["end"]) for x in rows.first().r]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("", []),
        ("a\nb\n", [(1, 2)]),
        ("f {\n  g { }\n}\nh {\n}\n", [(1, 3), (4, 5)]),
        ("f { // }\n}\nrest", [(1, 2), (3, 3)]),
        ("f { /* }\n} */\n}\n", [(1, 3)]),
        ('f("}{") {\n}\n', [(1, 2)]),
        ("f(`a\n}\n`) {\n}\nx\n", [(1, 4), (5, 5)]),
        ("} } {\n}\n", [(1, 1), (2, 1), (2, 2)]),
        ('x = "never closed {\n}\n', [(1, 2)]),
        ("f { '\\'}' }\nz", [(1, 1), (2, 2)]),
    ],
)
def test_brace_ranges(spark, code, want):
    assert _ranges(spark, code) == want


def test_brace_ranges_of_long_strings(spark):
    assert _ranges(spark, 'f("' + "x" * 300_000 + '}") {\n}\n') == [(1, 2)]


def test_reviewed(spark):
    scores = spark.createDataFrame([(1, "correcto"), (2, None), (3, "correcto")], "event_id int, human_feedback string")
    log = [(1, 1, "accept", " Ann ", "t1"), (2, 1, "accept", "Bob", "t1"), (2, 2, "clear", None, "t2"), (2, 3, "feedback", "falso_positivo", "t3"), (3, 1, "feedback", None, "t1"), (9, 1, "accept", "x", "t")]
    got = R.reviewed(scores, spark.createDataFrame(log, "event_id int, ord int, action string, value string, at string")).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == [(1, "correcto", "ann", "t1"), (2, "falso_positivo", None, None), (3, None, None, None)]


def test_rule_problem(spark):
    rule = "rule abc { strings: $a = \"x\" condition: any of them }"
    cases = [
        ("abc", "web", rule, "why", None),
        ("ab", "web", rule, "why", "name"),
        (None, "web", rule, "why", "name"),
        ("abc", "../web", rule, "why", "category"),
        ("abc", "web", rule + " " * K.MAX_RULE_CHARS, "why", "size"),
        ("abc", "web", rule, " \n", "rationale"),
        ("abc", "web", None, "why", "count"),
        ("abc", "web", rule + "\n" + rule, "why", "count"),
        ("abd", "web", rule, "why", "identifier"),
    ]
    rows = spark.createDataFrame(cases, "n string, c string, s string, r string, want string")
    assert [(r.got, r.want) for r in rows.withColumn("got", R.rule_problem(F.col("n"), F.col("c"), F.col("s"), F.col("r"))).collect() if r.got != r.want] == []


def test_text_rules(spark):
    body = lambda strings, condition: f"rule r {{\n strings:\n {strings}\n condition: {condition}\n}}"
    sources = [("a", body('$x = "Ab" nocase\n $y = "q\\"q"', "all of them")), ("b", body('$x = "Ab"\n $y = "zz"', "1 of them")), ("c", body("$x = { 00 }", "any of them")), ("d", body('$x = "a"', "filesize > 3")), ("e", body('$x = "a"', "3 of them"))]
    rules = R.text_rules(spark.createDataFrame(sources, "category string, source string"))
    texts = spark.createDataFrame([(1, 'aB q"q'), (2, "Ab"), (3, None), (4, "zz")], "id int, t string")
    assert sorted(tuple(r) for r in R.text_rule_hits(texts, rules, ["id"], "t").collect()) == [(1, "a.r", 60), (2, "b.r", 60), (4, "b.r", 60)]
    assert R.text_rule_hits(texts, rules.limit(0), ["id"], "t").count() == 0


def test_roles(spark):
    roles = spark.createDataFrame([("Ann ", "a", "revisor"), ("ann", "b", "mantenedor"), ("bob", "a", "revisor"), ("bob", "a", "dios")], "user_login string, repo string, role string")
    assert sorted(tuple(r) for r in R.highest_role(roles).collect()) == [("ann", "mantenedor"), ("bob", "revisor")]
    scores = spark.createDataFrame([(1, "x"), (2, None), (3, "correcto")], "event_id int, human_feedback string")
    assert sorted(tuple(r) for r in R.violations(scores, roles).collect()) == [("feedback", "1", 1), ("role", "bob@a", 1), ("unique_role", "bob@a", 2)]


def test_edges_and_upsert(spark):
    g = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "c")], "diff_id int, a string, b string")
    assert [tuple(r) for r in R.union_edges(g, g).collect()] == [(1, "a", "b")]
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n", 1), (2, "m", 2), (3, None, 1)], "k int, v string, ord int")
    assert sorted(tuple(r) for r in R.upsert(old, new, ["k"], "ord").collect()) == [(1, "o"), (2, "m"), (3, None)]


@dataclass(frozen=True)
class _Config:
    weights: int = 1
    audit: int = 2


def test_config():
    assert C.read_config(None) == C.read_config("") == C.read_config("# none") == {}
    assert C.read_config("a: 1") == {"a": 1}
    with pytest.raises(TypeError):
        C.read_config("- a")
    assert C.client_override(_Config(), None) == _Config() and C.client_override(_Config(), {"audit": 5}).audit == 5
    with pytest.raises(PermissionError):
        C.client_override(_Config(), {"weights": 0})
    with pytest.raises(ValueError):
        C.client_override(_Config(), {"other": 0})
