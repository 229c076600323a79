"""From diffs to scores: five independent branches over the changed files, joined once per change."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions import text as X
from ..functions.staging import spread, staged
from ..operators import matching
from ..sources import diffs as D
from ..sources import manifests

FINDING = ["diff_id", "layer", "ord", "path", "line", "rule_id", "message", "severity", "nature"]
LOG = logging.getLogger(__name__)
LAYER = ["diff_id", "layer", "score", "skipped", "crashed", "confidence", "category", "nature", "justification"]


@dataclass(frozen=True)
class Config:
    weights: dict[str, float] = field(default_factory=lambda: dict(K.WEIGHTS))
    yellow: int = K.YELLOW
    red: int = K.RED
    short_circuit: bool = False
    audit_one_in: int = 20
    #: Whether each layer is computed by itself, so that one that fails is crashed and the others go on.
    isolate: bool = False

    def without(self, *layers: str) -> Config:
        """The same with weight 0 for some layers, as the quick checks use it."""
        return Config({k: 0.0 if k in layers else v for k, v in self.weights.items()}, self.yellow, self.red, self.short_circuit, self.audit_one_in, self.isolate)


def override(config: Config, weights: dict[str, float] | None = None, yellow: int | None = None, red: int | None = None) -> Config:
    """Checked overrides: ``deps`` means ``dependencies``; weights lie in 0..1 and are brought to a sum of 1; thresholds in 0..100."""
    new = dict(config.weights)
    for k, v in (weights or {}).items():
        name = "dependencies" if k == "deps" else k
        if name not in new or not 0 <= v <= 1:  # also false for NaN
            raise ValueError(f"bad weight {k}={v}")
        new[name] = float(v)
    total = sum(new.values())
    if total <= 0:
        raise ValueError("no weight is left")
    if abs(total - 1) > 1e-4:
        new = {k: v / total for k, v in new.items()}
    limits = [config.yellow if yellow is None else yellow, config.red if red is None else red]
    if not all(isinstance(x, int) and 0 <= x <= 100 for x in limits):
        raise ValueError("thresholds are whole numbers from 0 to 100")
    return Config(new, *limits, config.short_circuit, config.audit_one_in, config.isolate)


def _layer(rows: DataFrame, name: str, **columns) -> DataFrame:
    empty = {"skipped": F.lit(False), "crashed": F.lit(False), "confidence": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "nature": F.lit(None).cast("string"), "justification": F.lit("")}
    values = empty | {"layer": F.lit(name)} | columns
    return rows.select(*(F.col(c) if c == "diff_id" else values[c].alias(c) for c in LAYER))


def _nature_counts(findings: DataFrame):
    return [F.count_if(F.col("nature") == n).alias(n) for n in (K.MALICIOUS, K.VULNERABILITY, K.UNCERTAIN)]


def static_layer(diff_ids: DataFrame, changes: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rule hits by file; files without any hit are scanned for suspicious added lines instead."""
    files = changes.filter(X.scannable(F.col("status"), F.col("is_binary"), F.col("diff_hunk"))).withColumn("language", X.rule_language(F.col("path")))
    hits = None
    if rules is not None:
        hits = matching.rule_hits(files.select("diff_id", "ord", "path", "language", "diff_hunk"), rules, ["diff_id", "ord", "path"], "diff_hunk").withColumns({"line": F.lit(1), "message": F.col("rule_id")})
        hits = hits.withColumn("nature", S.rule_nature(F.col("nature"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("rule_id")))
        files = files.join(hits.select("diff_id", "path").distinct(), ["diff_id", "path"], "left_anti")
    lines = files.select("diff_id", "ord", "path", F.explode(X.added_lines(F.col("diff_hunk"))).alias("a")).select("diff_id", "ord", "path", "a.line", F.explode(X.suspicious_labels(F.col("a.text"))).alias("label"), X.strip(F.col("a.text")).alias("t"))
    heuristic = lines.select("diff_id", "ord", "path", F.concat(F.lit("static.suspicious."), F.col("label")).alias("rule_id"), F.lit(90).alias("score"), F.lit(K.MALICIOUS).alias("nature"), "line", F.concat(F.lit("Suspicious pattern ("), F.col("label"), F.lit("): "), F.substr("t", F.lit(1), F.lit(80))).alias("message"))
    found = heuristic if hits is None else heuristic.unionByName(hits)
    findings = found.select("diff_id", F.lit("static").alias("layer"), F.row_number().over(Window.partitionBy("diff_id").orderBy("ord", "line", "rule_id")).cast("int").alias("ord"), "path", F.col("line").cast("int").alias("line"), "rule_id", "message", F.when(F.col("score") >= 50, "error").otherwise("warning").alias("severity"), "nature", "score")
    per = findings.groupBy("diff_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"), *_nature_counts(findings))
    rows = diff_ids.join(per, "diff_id", "left").fillna(0, ["score", "n", K.MALICIOUS, K.VULNERABILITY, K.UNCERTAIN])
    score = F.col("score").cast("int")
    layer = _layer(rows, "static", score=score, category=F.when(score >= 50, "OFUSCACION").otherwise("NINGUNA"), confidence=F.when(F.col("n") > 0, F.when(score >= 70, K.HIGH).when(score > 0, K.MEDIUM).otherwise(K.LOW)), nature=S.dominant_nature(F.col(K.MALICIOUS), F.col(K.VULNERABILITY), F.col(K.UNCERTAIN)), justification=F.concat(F.col("n"), F.lit(" static findings")))
    return layer, findings.select(*FINDING)


def dependency_layer(diff_ids: DataFrame, deps: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The highest score of any dependency: 75 for a lookalike or a direct URL, 80 for a suspicious script, 10 for a clean new one."""
    looks = matching.lookalikes(deps.select("ecosystem", "name"), reference)
    labels = X.suspicious_labels(F.coalesce("install_script", F.lit("")))
    rows = deps.join(looks, ["ecosystem", "name"], "left").withColumn("labels", labels)
    signal = F.greatest(F.when(F.col("looks_like").isNotNull(), 75).otherwise(0), F.when(F.size("labels") > 0, 80).otherwise(0), F.when(F.col("is_direct_url"), 75).otherwise(0))
    rows = rows.withColumn("signal", signal).withColumn("score", F.when((F.col("signal") == 0) & F.col("is_new"), 10).otherwise(F.col("signal")))
    notes = F.concat_ws("; ", F.when(F.col("looks_like").isNotNull(), F.concat(F.lit("looks like "), F.col("looks_like"))), F.when(F.size("labels") > 0, F.concat(F.lit("suspicious install script: "), F.array_join("labels", ", "))), F.when(F.col("is_direct_url"), F.lit("installed from a URL")), F.when(F.col("signal") == 0, F.lit("new dependency without signals")))
    findings = rows.filter("score > 0").select("diff_id", F.lit("dependencies").alias("layer"), F.row_number().over(Window.partitionBy("diff_id").orderBy("file_ord", "line_ord")).cast("int").alias("ord"), F.col("manifest_path").alias("path"), F.lit(None).cast("int").alias("line"), F.concat(F.lit("dependency-"), F.lower("ecosystem")).alias("rule_id"), F.concat(F.col("name"), F.coalesce(F.concat(F.lit("@"), F.col("version")), F.lit("")), F.lit(": "), notes).alias("message"), F.when(F.col("score") >= 60, "error").otherwise("warning").alias("severity"), F.when(F.col("signal") > 0, K.MALICIOUS).otherwise(K.VULNERABILITY).alias("nature"))
    per = rows.groupBy("diff_id").agg(F.max("score").alias("score"), F.count_if(F.col("signal") > 0).alias("bad"), F.count_if(F.col("score") > 0).alias("n"))
    all_rows = diff_ids.join(per, "diff_id", "left").fillna(0, ["score", "bad", "n"])
    score = F.col("score").cast("int")
    return _layer(all_rows, "dependencies", score=score, confidence=S.confidence_of(score), nature=S.dominant_nature(F.col("bad"), F.col("n"), F.lit(0))), findings


def advisory_expressions():
    """(high, description) over a struct ``v``: id, summary, severity array<struct<type, score>>, nominal array<string>, cvss string."""
    high = lambda v: F.exists(v["nominal"], lambda s: F.upper(s).isin("CRITICAL", "HIGH")) | F.coalesce(v["cvss"].try_cast("double") >= 7.0, F.lit(False)) | F.exists(v["severity"], lambda s: F.coalesce(S.cvss3(s["score"]) >= 7.0, F.lit(False)))

    def describe(vulns):
        grave = F.filter(vulns, high)
        top = F.coalesce(F.get(grave, F.lit(0)), F.get(vulns, F.lit(0)))
        labels = F.filter(F.transform(top["nominal"], lambda s: X.literal_map(K.SEVERITY_LABELS)[F.upper(s)]), lambda x: x.isNotNull())
        label = F.coalesce(F.get(labels, F.lit(0)), F.when(F.size(grave) > 0, "CRÍTICA/ALTA").otherwise("severidad no confirmada por OSV"))
        summary = F.when(F.length(top["summary"]) > 140, F.concat(F.rtrim(F.substr(top["summary"], F.lit(1), F.lit(139))), F.lit("…"))).otherwise(F.coalesce(top["summary"], F.lit("")))
        more = F.when(F.size(vulns) > 1, F.concat(F.lit(" +"), F.size(vulns) - 1)).otherwise("")
        return F.concat(top["id"], F.lit(" ("), label, F.lit(")"), F.when(summary != "", F.concat(F.lit(": "), summary)).otherwise(""), more)

    return high, describe


def vulnerability_layer(diff_ids: DataFrame, deps: DataFrame, advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``advisories`` (ecosystem, name, version, vulns): 90 for a grave advisory or five of any, 60 for others.

    A dependency without a row there is unverified: no score, but a warning. Scripts without a package are left out.
    """
    high, describe = advisory_expressions()
    rows = deps.filter(~F.endswith("name", F.lit(" (scripts)"))).join(advisories, ["ecosystem", "name", "version"], "left")
    rows = rows.withColumn("unverified", F.col("vulns").isNull())
    score = F.when(F.coalesce(F.size("vulns"), F.lit(0)) <= 0, 0).when(F.exists("vulns", high) | (F.size("vulns") >= 5), 90).otherwise(60)
    rows = rows.withColumn("score", F.when(F.col("unverified"), 0).otherwise(score))
    note = F.when(F.col("unverified"), F.lit("not verified")).otherwise(describe(F.col("vulns")))
    findings = rows.filter("score > 0 OR unverified").select("diff_id", F.lit("vulnerabilities").alias("layer"), F.row_number().over(Window.partitionBy("diff_id").orderBy("file_ord", "line_ord")).cast("int").alias("ord"), F.col("manifest_path").alias("path"), F.lit(None).cast("int").alias("line"), F.concat(F.when(F.col("unverified"), "vulnerability-unverified-").otherwise("vulnerability-"), F.lower("ecosystem")).alias("rule_id"), F.concat(F.col("name"), F.lit(": "), note).alias("message"), F.when(F.col("score") >= 60, "error").otherwise("warning").alias("severity"), F.lit(K.VULNERABILITY).alias("nature"))
    per = rows.groupBy("diff_id").agg(F.max("score").alias("score"))
    all_rows = diff_ids.join(per, "diff_id", "left").fillna(0, ["score"])
    s = F.col("score").cast("int")
    return _layer(all_rows, "vulnerabilities", score=s, confidence=S.confidence_of(s), nature=F.when(s > 0, K.VULNERABILITY)), findings


def reputation_layer(diff_ids: DataFrame, reputation: DataFrame) -> DataFrame:
    """Skipped where nothing is known about the author."""
    known = reputation.select("diff_id", S.reputation_score({c: F.col(c) for c in reputation.columns}).alias("score"), F.lit(True).alias("known"))
    rows = diff_ids.join(known, "diff_id", "left")
    return _layer(rows, "reputation", score=F.coalesce("score", F.lit(0)).cast("int"), skipped=F.col("known").isNull())


def semantic_stub(diff_ids: DataFrame, findings: DataFrame, changes: DataFrame) -> DataFrame:
    """A stand-in for the model's verdict, made from the other findings; labelled as such and never a model's output.

    Text in the hunks that is built to steer an analyser raises it to 100, as it would a model's.
    """
    worst = findings.groupBy("diff_id").agg(F.count_if(F.col("nature") == K.MALICIOUS).alias("bad"), F.count(F.lit(1)).alias("n"))
    steer = changes.groupBy("diff_id").agg(F.flatten(F.collect_list(X.injection_labels(F.col("diff_hunk")))).alias("labels"))
    rows = diff_ids.join(worst, "diff_id", "left").join(steer, "diff_id", "left").fillna(0, ["bad", "n"]).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    raw = F.when(F.col("bad") > 0, 85).when(F.col("n") > 0, 30).otherwise(5)
    score = S.injection_floor(raw, F.col("labels"))
    bad = (F.col("bad") > 0) | (score == 100)
    return _layer(rows, "semantic", score=score.cast("int"), confidence=F.lit(K.MEDIUM), nature=F.when(bad, K.MALICIOUS).when(F.col("n") > 0, K.VULNERABILITY).otherwise(K.UNCERTAIN), category=F.when(bad, "OFUSCACION").otherwise("NINGUNA"), justification=F.lit("stub"))


@dataclass(frozen=True)
class Inputs:
    """What a layer may start from: ids (diff_id), changes, deps, the reference tables, and for late layers the findings of the others."""

    ids: DataFrame
    changes: DataFrame
    deps: DataFrame
    reference: DataFrame
    advisories: DataFrame
    reputation: DataFrame
    rules: DataFrame | None
    findings: DataFrame | None
    config: Config


#: A layer: from Inputs to its rows (LAYER, one for each change) and its findings (FINDING) or None.
Layer = Callable[[Inputs], tuple[DataFrame, DataFrame | None]]
REGISTRY: dict[str, Layer] = {}
#: Layers that need the findings of the others.
LATE: set[str] = set()


def layer(name: str, late: bool = False) -> Callable[[Layer], Layer]:
    """Registers a layer by the name of its weight; the last one of a name counts. It runs wherever its weight is over 0."""

    def add(f: Layer) -> Layer:
        REGISTRY[name] = f
        (LATE.add if late else LATE.discard)(name)
        return f

    return add


layer("static")(lambda x: static_layer(x.ids, x.changes, x.rules))
layer("dependencies")(lambda x: dependency_layer(x.ids, x.deps, x.reference))
layer("vulnerabilities")(lambda x: vulnerability_layer(x.ids, x.deps, x.advisories))
layer("reputation")(lambda x: (reputation_layer(x.ids, x.reputation), None))


@layer("semantic", late=True)
def _(x: Inputs) -> tuple[DataFrame, DataFrame | None]:
    return semantic_stub(x.ids, x.findings, x.changes), None


@dataclass
class Analysis:
    changes: DataFrame
    dependencies: DataFrame
    layers: DataFrame
    findings: DataFrame
    results: DataFrame


def combine(layers: DataFrame, config: Config) -> DataFrame:
    """(diff_id, score, verdict, weights): one row per change out of the long layer table; one shuffle."""
    cell = F.struct("score", "skipped", "crashed", "confidence", "category", "nature")
    names = [*K.LAYERS, *sorted(n for n in config.weights if n not in K.LAYERS)]
    wide = layers.groupBy("diff_id").pivot("layer", names).agg(F.first(cell))
    by = {n: F.col(n) for n in names}
    score = S.final_score(by, config.weights, config.yellow, config.red)
    return wide.select("diff_id", score.alias("score"), S.verdict(score, config.yellow, config.red).alias("verdict"), S.effective_weights(by, config.weights).alias("weights"))


def analyze(diffs: DataFrame, reference: DataFrame, advisories: DataFrame, reputation: DataFrame, rules: DataFrame | None = None, blocked: DataFrame | None = None, config: Config | None = None, layers: dict[str, Layer] | None = None) -> Analysis:
    """``diffs`` (diff_id, diff). ``blocked`` (diff_id): changes of blocked authors, which score 100 at once.

    All registered layers with a weight over 0 are run; ``layers`` are used in place of registered ones of their names. With ``short_circuit`` the changes that the cheap layers decide have a skipped
    semantic layer and the verdict of the short circuit.
    """
    config = config or Config()
    ids = diffs.select("diff_id").distinct()
    if blocked is not None:
        stopped = ids.join(blocked, "diff_id", "left_semi")
        ids, diffs = ids.join(blocked, "diff_id", "left_anti"), diffs.join(blocked, "diff_id", "left_anti")
    changes = staged(D.file_changes(spread(diffs, "diff_id")))  # every branch starts from these two, in as many tasks
    deps = staged(manifests.dependency_changes(changes))
    use = {n: f for n, f in (REGISTRY | (layers or {})).items() if config.weights.get(n, 0) > 0}
    given = Inputs(ids, changes, deps, reference, advisories, reputation, rules, None, config)
    rows, findings = {}, []

    def run(name: str, given: Inputs) -> tuple[DataFrame, DataFrame | None]:
        if not config.isolate:
            return use[name](given)
        try:
            own, found_ = use[name](given)
            return staged(own), None if found_ is None else staged(found_)
        except Exception as e:  # whatever a layer's plan or its tasks raise
            LOG.warning("layer %s failed: %s", name, e)
            return _layer(ids, name, score=F.lit(0), skipped=F.lit(True), crashed=F.lit(True), justification=F.lit("")), None

    for name in S.in_order({n: None for n in use if n not in LATE}):
        rows[name], own = run(name, given)
        if own is not None:
            findings.append(own)
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    found = staged(union(findings)) if findings else None
    decided = None
    if found is not None:
        given = replace(given, findings=found)
        early = list(rows)
        for name in S.in_order({n: None for n in use if n in LATE}):
            rows[name], _ = run(name, given)
        if config.short_circuit and "semantic" in rows:
            cell = F.struct("score", "skipped", "crashed", "confidence", "category", "nature")
            wide = union([rows[n] for n in early]).groupBy("diff_id").pivot("layer", [n for n in K.LAYERS if n != "semantic"] + [n for n in early if n not in K.LAYERS]).agg(F.first(cell))
            forced = changes.groupBy("diff_id").agg(F.bool_or(F.rlike("path", F.lit(K.FORCING_PATHS)) | (~F.col("is_binary") & F.rlike("diff_hunk", F.lit(K.NETWORK_CALLS)))).alias("forced"))
            fresh = deps.filter(F.col("is_new") | F.col("install_script").isNotNull() | F.col("is_direct_url")).select("diff_id").distinct().withColumn("deps", F.lit(True))
            both = wide.join(forced, "diff_id", "left").join(fresh, "diff_id", "left")
            audit = F.pmod(F.xxhash64("diff_id"), F.lit(config.audit_one_in)) == 0
            light = S.short_circuit({n: F.col(n) for n in wide.columns if n != "diff_id"}, F.coalesce("forced", F.lit(False)) | F.coalesce("deps", F.lit(False)), audit, config.weights, config.yellow, config.red)
            decided = both.select("diff_id", light.alias("light")).filter("light IS NOT NULL")
            rows["semantic"] = rows["semantic"].join(decided, "diff_id", "left").withColumn("skipped", F.col("skipped") | F.col("light").isNotNull()).select(*LAYER)
    every = staged(union(list(rows.values())))
    results = combine(every, config)
    if decided is not None:
        results = results.join(decided, "diff_id", "left").withColumn("verdict", F.coalesce("light", "verdict")).drop("light")
    counts = found.groupBy("diff_id").agg(F.count_if(F.col("nature") == K.MALICIOUS).alias("malicious"), F.count_if(F.col("nature") == K.VULNERABILITY).alias("vulnerable"), F.count_if(F.col("nature") == K.UNCERTAIN).alias("uncertain")) if found is not None else None
    results = results.join(counts, "diff_id", "left").fillna(0, ["malicious", "vulnerable", "uncertain"]) if counts is not None else results.withColumns({c: F.lit(0).cast("long") for c in ("malicious", "vulnerable", "uncertain")})
    if blocked is not None:
        results = results.unionByName(stopped.select("diff_id", F.lit(100).alias("score"), F.lit(K.RED_LIGHT).alias("verdict"), F.create_map(F.lit("blocked"), F.lit(1.0)).alias("weights"), F.lit(1).cast("long").alias("malicious"), F.lit(0).cast("long").alias("vulnerable"), F.lit(0).cast("long").alias("uncertain")))
    return Analysis(changes, deps, every, found, results)
