"""Reports of a change's findings: rows and documents of SARIF, JSON and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.engine import retry_hints

ANCHOR = ".palisade.yml"
#: Fixed values of the format.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"


def level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warn", "warning").otherwise("note")


def sarif_results(findings: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """A SARIF result a finding; one without a file points at the policy file."""
    return findings.select("change_id", F.concat("gate", F.lit("/"), "rule_id").alias("rule"), level(F.col("severity")).alias("level"), "message", F.coalesce("file", F.lit(anchor)).alias("uri"), F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).cast("long").alias("start_line"))


def placed(findings: DataFrame, *columns: str) -> DataFrame:
    """``change_id, f``: a change's findings in order of gate, file, line and rule, as an array of ``columns``."""
    order = F.struct("gate_ord", F.coalesce("file", F.lit("")).alias("o1"), F.coalesce("line", F.lit(0)).alias("o2"), "rule_ord", F.struct(*columns).alias("x"))
    return findings.groupBy("change_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda y: y["x"]).alias("f"))


def none_of(column: str, table: DataFrame) -> Column:
    return F.coalesce(column, F.array().cast(table.schema[column].dataType))


def distinct_rules(findings: DataFrame) -> DataFrame:
    """``change_id, rule_pos, rule``: a run's different rules in order of first occurrence, from 0."""
    rules = placed(findings.withColumn("rule", F.concat("gate", F.lit("/"), "rule_id")), "rule")
    return rules.select("change_id", F.posexplode(F.array_distinct(F.transform("f", lambda x: x["rule"]))).alias("rule_pos", "rule"))


def sarif_documents(changes: DataFrame, findings: DataFrame, tool: str = "palisade", anchor: str = ANCHOR) -> DataFrame:
    """``change_id, sarif``: a whole log a change, also without findings; lists that are empty are written as such."""
    found = placed(findings, "gate", "rule_id", "severity", "message", "file", "line")
    out = changes.select("change_id").join(found, "change_id", "left").withColumn("f", none_of("f", found))
    name = lambda x: F.concat(x["gate"], F.lit("/"), x["rule_id"])
    rules = F.array_distinct(F.transform("f", lambda x: F.struct(name(x).alias("id"), x["rule_id"].alias("name"))))
    region = lambda x: F.when((F.coalesce(x["file"], F.lit("")) != "") & (x["line"] > 0), F.struct(x["line"].alias("startLine")))
    place = lambda x: F.struct(F.struct(F.struct(F.coalesce(F.nullif(x["file"], F.lit("")), F.lit(anchor)).alias("uri")).alias("artifactLocation"), region(x).alias("region")).alias("physicalLocation"))
    results = F.transform("f", lambda x: F.struct(name(x).alias("ruleId"), level(x["severity"]).alias("level"), F.struct(x["message"].alias("text")).alias("message"), F.array(place(x)).alias("locations")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return out.select("change_id", F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def html_safe(json: Column) -> Column:
    """JSON with ``<``, ``>`` and ``&`` as escapes; these signs occur in strings only."""
    for sign, code in (("<", "003c"), (">", "003e"), ("&", "0026")):
        json = F.replace(json, F.lit(sign), F.lit("\\u" + code))
    return json


def json_reports(verdict: DataFrame, findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``change_id, report``: result, findings in order, summary, hints and, where gates failed, their errors; empty lists are written as such."""
    found = placed(findings, *[c for c in ("gate", "rule_id", "severity", "file", "line", "message", "suggestion", "docs_url", "retry_hint", "fix") if c in findings.columns])
    hints = retry_hints(findings).groupBy("change_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hint_ord", "retry_hint"))), lambda x: x["retry_hint"]).alias("h"))
    out = verdict.join(found, "change_id", "left").join(hints, "change_id", "left")
    summary = F.struct(F.col("n_findings").alias("findings"), F.col("n_errors").alias("errors"), F.col("n_warnings").alias("warnings"), F.col("n_info").alias("info"), F.col("n_gate_errors").alias("gate_errors"))
    parts = ["result", none_of("f", found).alias("findings"), summary.alias("summary"), none_of("h", hints).alias("retry_hints")]
    if errors is not None:
        failed = errors.groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct("gate", "error"))).alias("e"))
        out = out.join(failed, "change_id", "left")
        parts.append(F.col("e").alias("gate_errors"))
    return out.select("change_id", html_safe(F.to_json(F.struct(*parts))).alias("report"))


def text_reports(verdict: DataFrame, findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``change_id, report`` for people: findings by gate, gates by name, then failed gates and a last line that says what came of it."""
    place = F.when(F.coalesce("file", F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), "file", F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise("")))
    line = F.concat(F.lit("  ["), "severity", F.lit("] "), "message", place)
    order = F.struct(F.coalesce("file", F.lit("")).alias("o1"), F.coalesce("line", F.lit(0)).alias("o2"), "rule_ord", line.alias("x"))
    own = findings.groupBy("change_id", "gate").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda y: y["x"]), "\n").alias("x"))
    each = own.select("change_id", F.lit(0).alias("k"), "gate", F.concat("gate", F.lit("\n"), "x").alias("x"))
    if errors is not None:
        each = each.unionByName(errors.select("change_id", F.lit(1).alias("k"), "gate", F.concat("gate", F.lit("\n  [error] the gate failed: "), "error").alias("x")))
    body = each.groupBy("change_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "gate", "x"))), lambda y: y["x"]), "\n\n").alias("body"))
    count = lambda c: F.col(c).cast("string")
    last = F.when(F.col("result") == "blocked", F.concat(F.lit("blocked: "), count("n_findings"), F.lit(" finding(s), "), count("n_errors"), F.lit(" error(s)"))).otherwise(F.concat(count("n_findings"), F.lit(" advisory finding(s), not blocked")))
    return verdict.join(body, "change_id", "left").select("change_id", F.when(F.col("body").isNull(), "no findings").otherwise(F.concat("body", F.lit("\n\n"), last)).alias("report"))
