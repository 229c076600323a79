"""Scores and findings as reports: JSON, SARIF, comments and CI annotations.

``results``: one row per change with diff_id, score, verdict and threat counts; ``findings``: diff_id, layer, ord, path, line,
rule_id, message, severity, nature; ``layers``: diff_id, layer, score, skipped, justification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X


def json_report(results: DataFrame) -> DataFrame:
    return results.select("diff_id", F.to_json(F.struct(*[c for c in results.columns if c != "diff_id"])).alias("report"))


def _level(severity):
    low = F.lower(severity)
    return F.when(low == "error", "error").when(low.isin("warning", "warn"), "warning").otherwise("note")


def sarif(results: DataFrame, layers: DataFrame, findings: DataFrame) -> DataFrame:
    """(diff_id, sarif): one SARIF 2.1.0 run each. Rules are distinct, first seen first.

    A layer without findings gives one result of its own if its score is at least the yellow threshold.
    """
    heard = layers.filter(~F.col("skipped"))
    place = F.struct(F.struct(F.struct(X.sarif_path(F.col("path")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    rows = findings.join(heard.select("diff_id", "layer"), ["diff_id", "layer"], "left_semi").select("diff_id", F.struct("layer", "ord").alias("k"), F.struct(F.col("rule_id").alias("ruleId"), _level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")).alias("result"))
    quiet = heard.join(findings.select("diff_id", "layer").distinct(), ["diff_id", "layer"], "left_anti").filter(F.col("score") >= K.YELLOW)
    own = F.struct(F.struct(F.struct(F.lit("repository").alias("uri")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine")).alias("region")).alias("physicalLocation"))
    extra = quiet.select("diff_id", F.struct("layer", F.lit(0).cast("int").alias("ord")).alias("k"), F.struct(F.concat(F.lit("layer-"), F.col("layer")).alias("ruleId"), F.when(F.col("score") >= K.RED, "error").otherwise("warning").alias("level"), F.struct(F.col("justification").alias("text")).alias("message"), F.array(own).alias("locations")).alias("result"))
    every = rows.unionByName(extra)
    rules = every.groupBy("diff_id", F.col("result.ruleId").alias("id")).agg(F.min("k").alias("first")).groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "id"))), lambda r: F.struct(r["id"].alias("id"))).alias("rules"))
    runs = every.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "result"))), lambda r: r["result"]).alias("results"))
    kind = runs.schema["results"].dataType.simpleString()
    full = results.select("diff_id").join(runs, "diff_id", "left").join(rules, "diff_id", "left").withColumns({"results": F.coalesce("results", F.array().cast(kind)), "rules": F.coalesce("rules", F.array().cast("array<struct<id: string>>"))})
    run = F.struct(F.struct(F.struct(F.lit("riskloom").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return full.select("diff_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def comments(results: DataFrame, layers: DataFrame) -> DataFrame:
    """(diff_id, comment): score, verdict and a line per layer; no details when any finding is malicious."""
    name = F.concat(F.upper(F.left("layer", F.lit(1))), F.lower(F.substr("layer", F.lit(2))))
    line = F.concat(name, F.lit(": "), F.when(F.col("skipped"), F.lit("skipped")).otherwise(F.concat(F.col("score"), F.lit("/100"))))
    order = F.array_position(F.array(*(F.lit(x) for x in K.LAYERS)), F.col("layer"))
    detail = layers.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))), lambda r: r["t"]), "\n").alias("detail"))
    head = F.concat(F.lit("Risk "), F.col("score"), F.lit("/100 ("), F.col("verdict"), F.lit(")"))
    action = F.when(F.col("verdict") == K.RED_LIGHT, "Needs a human review before merging.").when(F.col("verdict") == K.YELLOW_LIGHT, "Fix the warnings before merging.").otherwise("Ready to merge.")
    body = F.when(F.col("malicious") > 0, "Details are withheld.").otherwise(F.coalesce("detail", F.lit("")))
    return results.join(detail, "diff_id", "left").select("diff_id", F.concat_ws("\n", head, body, action).alias("comment"))


def annotations(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(diff_id, ord, annotation): one workflow command for the score, one for each finding, with escaped values."""
    top = F.when(F.col("verdict") == K.RED_LIGHT, "error").when(F.col("verdict") == K.YELLOW_LIGHT, "warning").otherwise("notice")
    text = F.concat(F.lit("Risk "), F.col("score"), F.lit("/100 ("), F.upper("verdict"), F.lit(")"))
    head = results.select("diff_id", F.lit(0).alias("ord"), F.concat(F.lit("::"), top, F.lit(" title=Risk score::"), X.escape_data(text)).alias("annotation"))
    props = F.concat_ws(",", F.concat(F.lit("title="), X.escape_property(F.col("layer"))), F.when(F.col("path") != "", F.concat(F.lit("file="), X.escape_property(F.col("path")))), F.when(F.col("line").isNotNull(), F.concat(F.lit("line="), F.col("line"))))
    level = F.when(F.lower("severity") == "error", "error").otherwise("warning")
    rest = findings.select("diff_id", (F.col("ord") + 1).alias("ord"), F.concat(F.lit("::"), level, F.lit(" "), props, F.lit("::"), X.escape_data(F.col("message"))).alias("annotation"))
    return head.unionByName(rest)


def flat_score_rows(results: DataFrame, layers: DataFrame) -> DataFrame:
    """History rows: one column per layer; a missing layer has a null score and counts as skipped."""
    wide = layers.groupBy("diff_id").pivot("layer", list(K.LAYERS)).agg(F.first("score").alias("score"), F.first("skipped").alias("skipped"))
    out = results.join(wide, "diff_id", "left")
    return out.withColumns({f"{x}_skipped": F.coalesce(f"{x}_skipped", F.lit(True)) for x in K.LAYERS})
