"""Golden values of the scoring core."""

from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.functions import scoring as S
from riskloom.plans import analyze as A

LAYER = "struct<score: int, skipped: boolean, crashed: boolean, confidence: string, category: string, nature: string>"


def layers(spark, **given):
    full = {n: given.get(n) for n in K.LAYERS}
    cells = {n: None if v is None else (v[0], *(list(v[1:]) + [False, False, None, None, None][len(v) - 1 :])) for n, v in full.items()}
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} {LAYER}" for n in cells))


def score(spark, weights=K.WEIGHTS, **given):
    df = layers(spark, **given)
    return df.select(S.final_score({n: F.col(n) for n in K.LAYERS}, weights)).first()[0]


def test_weighted_score(spark):
    w = {"static": 0.25, "dependencies": 0.20, "reputation": 0.15, "semantic": 0.40}
    assert score(spark, w, static=(20,), dependencies=(10,), reputation=(40,), semantic=(85,)) == 47
    assert score(spark, static=(90,), semantic=(0, True)) == 90
    assert score(spark, static=(90, True)) == 0
    assert score(spark, {"static": 0.5, "semantic": 0.5}, static=(52,), semantic=(53,)) == 52  # half to even


def test_floors_and_policies(spark):
    assert score(spark, static=(0,), semantic=(85, False, False, "alta", "BACKDOOR", None)) == 70
    assert score(spark, static=(0,), semantic=(10, False, False, "media", None, "malicioso")) == 70
    assert score(spark, static=(0,), dependencies=(0,), vulnerabilities=(0,), reputation=(0,), semantic=(72, False, False, "alta", None, None)) == 40
    assert score(spark, static=(0,), dependencies=(0,), vulnerabilities=(0,), reputation=(0,), semantic=(45, False, False, "baja", None, "incertidumbre")) == 40


def test_verdict_borders(spark):
    df = spark.createDataFrame([(39,), (40,), (69,), (70,)], "s int")
    assert [r[0] for r in df.select(S.verdict(F.col("s"))).collect()] == ["verde", "amarillo", "amarillo", "rojo"]


def short(spark, weights, forced=False, audit=False, **given):
    df = layers(spark, **given)
    return df.select(S.short_circuit({n: F.col(n) for n in K.LAYERS}, F.lit(forced), F.lit(audit), weights)).first()[0]


def test_short_circuit(spark):
    small = {"static": 0.3, "dependencies": 0.3, "reputation": 0.3, "semantic": 0.1}
    assert short(spark, small, static=(90,), dependencies=(90,), reputation=(90,)) == "rojo"
    assert short(spark, {"static": 0.2, "dependencies": 0.2, "reputation": 0.2, "semantic": 0.4}, static=(100,), dependencies=(100,), reputation=(100,)) is None
    calm = {"static": (5,), "dependencies": (5,), "reputation": (5,)}
    assert short(spark, K.WEIGHTS, **calm) == "verde"
    assert short(spark, K.WEIGHTS, audit=True, **calm) is None
    assert short(spark, K.WEIGHTS, forced=True, **calm) is None
    assert short(spark, K.WEIGHTS, static=(0, True, True), dependencies=(5,)) is None
    assert short(spark, K.WEIGHTS, static=(1, False, False, "alta", None, "malicioso")) == "rojo"


def test_cvss(spark):
    rows = [
        ("CVSS:3.1/AV:N/AC:L/PR:H/UI:N/S:U/C:H/I:H/A:H", 7.2),
        ("CVSS:3.0/AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:H/A:H", 7.4),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:L", 5.3),
        ("CVSS:2.0/AV:N/AC:L/Au:N/C:P/I:P/A:P", None),
        ("CVSS:3.1/AV:N", None),
        ("", None),
    ]
    got = spark.createDataFrame(rows, "v string, want double").select(S.cvss3(F.col("v")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_reputation(spark):
    row = {"account_age_days": 3, "public_repos": 5, "followers": 1, "prior_contributions": 0, "email_verified": False, "repo_signs": False, "commit_signed": False, "key_seen": None, "prior_high_risk": False}
    df = spark.createDataFrame([tuple(row.values())], "account_age_days int, public_repos int, followers int, prior_contributions int, email_verified boolean, repo_signs boolean, commit_signed boolean, key_seen boolean, prior_high_risk boolean")
    assert df.select(S.reputation_score({c: F.col(c) for c in row})).first()[0] == 55


def test_overrides():
    c = A.override(A.Config(), {"deps": 0.0})
    assert c.weights["dependencies"] == 0 and abs(sum(c.weights.values()) - 1) < 1e-9
    for bad in ({"static": float("nan")}, {"static": 2}, {"other": 0.1}):
        try:
            A.override(A.Config(), bad)
        except ValueError:
            continue
        raise AssertionError(bad)
