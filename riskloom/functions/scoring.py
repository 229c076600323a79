"""Scores, verdicts and policies. Layers stand in columns, one struct each, in the fixed order of ``LAYERS``.

A layer struct has: score int, skipped boolean, crashed boolean, confidence, category and nature strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import bound, literal_map


def verdict(score: Column, yellow: int = K.YELLOW, red: int = K.RED) -> Column:
    return F.when(score >= red, K.RED_LIGHT).when(score >= yellow, K.YELLOW_LIGHT).otherwise(K.GREEN_LIGHT)


def _active(layer: Column, weight: float) -> Column:
    return layer.isNotNull() & ~F.coalesce(layer["skipped"], F.lit(True)) & F.lit(weight > 0)


def in_order(layers: dict[str, Column]) -> list[str]:
    """Names of layers in the order of sums: the usual ones in their fixed order, then others by name."""
    return [n for n in K.LAYERS if n in layers] + sorted(n for n in layers if n not in K.LAYERS)


def weighted_mean(layers: dict[str, Column], weights: dict[str, float] = K.WEIGHTS, extra: float = 0.0) -> Column:
    """Mean of the active layers' scores by weight; 0 if none is active. ``extra``: weight of a layer with score 0."""
    top, below = F.lit(0.0), F.lit(0.0)
    for name in in_order(layers):
        w = weights.get(name, 0.0)
        top = top + F.when(_active(layers[name], w), F.lit(w) * layers[name]["score"]).otherwise(0.0)
        below = below + F.when(_active(layers[name], w), F.lit(w)).otherwise(0.0)
    below = below + F.lit(extra)
    return F.when(below > 0, top / below).otherwise(0.0)


def effective_weights(layers: dict[str, Column], weights: dict[str, float] = K.WEIGHTS) -> Column:
    """map: each layer's share of the active weight, to four places; 0 if inactive."""
    total = F.lit(0.0)
    for name in in_order(layers):
        total = total + F.when(_active(layers[name], weights.get(name, 0.0)), F.lit(weights.get(name, 0.0))).otherwise(0.0)
    share = lambda n: F.when((total > 0) & _active(layers[n], weights.get(n, 0.0)), F.round(F.lit(weights.get(n, 0.0)) / total, 4)).otherwise(0.0)
    return F.create_map(*(x for n in in_order(layers) for x in (F.lit(n), share(n))))


def final_score(layers: dict[str, Column], weights: dict[str, float] = K.WEIGHTS, yellow: int = K.YELLOW, red: int = K.RED) -> Column:
    """The rounded mean (half to even), raised by what the semantic layer is sure of."""
    score = F.bround(weighted_mean(layers, weights)).cast("int")
    if "semantic" not in layers:
        return score
    s = layers["semantic"]
    heard = s.isNotNull() & ~F.coalesce(s["skipped"], F.lit(True))
    sure = F.coalesce(s["confidence"] == K.HIGH, F.lit(False))
    severe = heard & sure & F.coalesce(s["category"].isin(*K.SEVERE_CATEGORIES), F.lit(False)) & (s["score"] >= K.SEVERE_FLOOR)
    hostile = heard & F.coalesce((s["nature"] == K.MALICIOUS) & s["confidence"].isin(K.HIGH, K.MEDIUM), F.lit(False))
    score = F.when(severe | hostile, F.greatest(score, F.lit(red))).otherwise(score)
    doubt = heard & F.coalesce((s["nature"] == K.UNCERTAIN) & (s["score"] >= yellow), F.lit(False))
    raised = ((heard & sure & (s["score"] >= red)) | doubt) & (score < yellow)
    return F.when(raised, F.lit(yellow)).otherwise(score)


def short_circuit(layers: dict[str, Column], forced: Column, audit: Column, weights: dict[str, float] = K.WEIGHTS, yellow: int = K.YELLOW, red: int = K.RED) -> Column:
    """A verdict that needs no semantic layer, or null. ``audit``: the row is in the sample that is analysed anyway."""
    partial = {n: c for n, c in layers.items() if n != "semantic"}
    any_of = lambda f: F.coalesce(F.array_max(F.array(*(f(c) for c in partial.values()))), F.lit(False))
    hostile = any_of(lambda c: F.coalesce(~c["skipped"] & (c["nature"] == K.MALICIOUS) & (c["confidence"] == K.HIGH), F.lit(False)))
    crashed = any_of(lambda c: F.coalesce(c["crashed"], F.lit(False)))
    least = F.bround(weighted_mean(partial, weights, max(0.0, weights.get("semantic", 0.0))))
    calm = (weighted_mean(partial, weights) < yellow * 0.5) & ~forced & ~crashed
    return F.when(hostile, K.RED_LIGHT).when(least >= red, K.RED_LIGHT).when(calm & ~audit, K.GREEN_LIGHT)


def reputation_score(r: dict[str, Column]) -> Column:
    """Additive signals up to 100; a prior high-risk change is 100 alone. Unknown (null) signals don't fire."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    age = r["account_age_days"]
    signals = [
        (yes(age < 30), 10),
        (yes((r["public_repos"] == 0) & (r["followers"] == 0) & (age < 90)), 15),
        (yes(r["prior_contributions"] == 0), 20),
        (~yes(r["email_verified"]), 25),
        (yes(r["repo_signs"]) & ~yes(r["commit_signed"]), 30),
        (yes(r["commit_signed"]) & yes(~r["key_seen"]), 40),
    ]
    total = F.lit(0)
    for fires, points in signals:
        total = total + F.when(fires, points).otherwise(0)
    return F.when(yes(r["prior_high_risk"]), F.lit(100)).otherwise(F.least(F.lit(100), total))


def confidence_of(score: Column) -> Column:
    return F.when(score >= 70, K.HIGH).when(score >= 40, K.MEDIUM).when(score > 0, K.LOW)


def dominant_nature(malicious: Column, vulnerability: Column, uncertain: Column) -> Column:
    """The gravest nature with any finding; null without findings."""
    return F.when(malicious > 0, K.MALICIOUS).when(vulnerability > 0, K.VULNERABILITY).when(uncertain > 0, K.UNCERTAIN)


def cvss_roundup(value: Column) -> Column:
    n = F.bround(value * 100000).cast("long")
    return F.when(n % 10000 == 0, n / 100000.0).otherwise((F.floor(n / 10000) + 1) / 10.0)


def cvss3(vector: Column) -> Column:
    """Base score of a CVSS 3 vector; null for other versions or if a metric is missing or unknown. Each step is computed once."""

    def metrics(m: Column) -> Column:
        at = lambda table, key: literal_map(table)[F.element_at(m, F.lit(key))]
        scope = F.element_at(m, F.lit("S"))
        pr = F.when(scope == "C", at(K.CVSS_PR_CHANGED, "PR")).otherwise(at(K.CVSS_PR_UNCHANGED, "PR"))
        c, i, a = (at(K.CVSS_CIA, k) for k in ("C", "I", "A"))
        easy = 8.22 * at(K.CVSS_AV, "AV") * at(K.CVSS_AC, "AC") * pr * at(K.CVSS_UI, "UI")
        return F.struct(scope.alias("scope"), easy.alias("easy"), (1 - ((1 - c) * (1 - i) * (1 - a))).alias("iss"))

    def impact(x: Column) -> Column:
        iss = x["iss"]
        return F.struct(x["scope"].alias("scope"), x["easy"].alias("easy"), iss.alias("iss"), F.when(x["scope"] == "C", 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15)).otherwise(6.42 * iss).alias("impact"))

    def score(x: Column) -> Column:
        raw = (x["impact"] + x["easy"]) * F.when(x["scope"] == "C", 1.08).otherwise(1.0)
        known = x["scope"].isNotNull() & x["easy"].isNotNull() & x["iss"].isNotNull()
        return F.when(known, F.when((x["iss"] <= 0) | (x["impact"] <= 0), F.lit(0.0)).otherwise(bound(F.least(raw, F.lit(10.0)), cvss_roundup)))

    found = bound(bound(bound(F.str_to_map(vector, F.lit("/"), F.lit(":")), metrics), impact), score)
    return F.when(F.startswith(vector, F.lit("CVSS:3.")), found)


def guidance(verdict_: Column) -> Column:
    return F.when(verdict_ == K.GREEN_LIGHT, "PROCEED").when(verdict_ == K.YELLOW_LIGHT, "RETRY_WITH_FIX").otherwise("BLOCK_HUMAN_REVIEW")


def finding_signature(rule: Column, path: Column, severity: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws(":", rule, path, severity, message), 256)


def unverified_floor(score: Column, unverified: Column, fetched: Column) -> Column:
    """At least 60 if content was left unread and none of its paths was fetched."""
    fires = (F.size(unverified) > 0) & ~F.arrays_overlap(unverified, fetched)
    return F.when(fires, F.greatest(score, F.lit(K.UNVERIFIED_FLOOR))).otherwise(score)


def injection_floor(score: Column, labels: Column) -> Column:
    """100 if any label shows text built to be taken for an analyser's answer."""
    return F.when(F.arrays_overlap(labels, F.array(*(F.lit(x) for x in K.STRUCTURAL_INJECTION))), F.lit(100)).otherwise(score)


def borderline(score: Column, yellow: int = K.YELLOW, red: int = K.RED) -> Column:
    return (F.abs(score - yellow) <= K.BORDERLINE_MARGIN) | (F.abs(score - red) <= K.BORDERLINE_MARGIN)


def budget_left(limit: Column, used: Column) -> Column:
    """Null (no limit) stays null; a limit of 0 or less leaves 0."""
    return F.when(limit.isNull(), F.lit(None).cast("long")).when(limit <= 0, F.lit(0)).otherwise(limit - used)


def rule_nature(declared: Column, category: Column, subcategory: Column, nature: Column, rule_id: Column) -> Column:
    """The declared nature of a rule, else what its metadata says, else by keywords."""
    words = r"\b(?:" + "|".join(K.MALICIOUS_KEYWORDS) + r")\b"
    said = F.lower(F.coalesce(nature, F.lit("")))
    hit = F.lit(False)
    for c in (category, subcategory, rule_id):
        hit = hit | F.rlike(F.lower(F.coalesce(c, F.lit(""))), F.lit(words))
    return F.coalesce(declared, F.when(said.isin("malicioso", "malicious"), K.MALICIOUS).when(said.isin("vulnerabilidad", "vulnerability"), K.VULNERABILITY).when(hit, K.MALICIOUS).otherwise(K.VULNERABILITY))
