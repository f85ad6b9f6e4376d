"""Records of what people and checks did: bypasses, provenance, feedback, markers and manifests, as rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.gates import go_quoted


def rfc3339(moment: Column) -> Column:
    """A timestamp as text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bypasses(changes: DataFrame, mode: str) -> DataFrame:
    """``change_id, record, token, note`` for ``changes(change_id, at, reason, branch, tree_hash)``: a log line, the one-shot token's text and the commit's note.

    Strict mode refuses bypasses, and so does a lack of a reason.
    """
    given = changes.where(F.lit(mode != "ci_strict") & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    record = F.to_json(F.struct(rfc3339(F.col("at")).alias("timestamp"), "reason", "branch", "tree_hash"))
    return given.select("change_id", record.alias("record"), F.concat("reason", F.lit("\n")).alias("token"), F.concat(F.lit("bypass: "), "reason").alias("note"))


def provenance_notes(detected: DataFrame, verdict: DataFrame) -> DataFrame:
    """``change_id, note``: a JSON note of agent and source on each agent's change that a check passed."""
    passed = verdict.where("exit_code = 0").select("change_id")
    return detected.where("is_agent").join(passed, "change_id", "left_semi").select("change_id", F.to_json(F.struct(F.nullif("agent", F.lit("")).alias("agent"), F.col("prov_source").alias("source"))).alias("note"))


def feedback(reports: DataFrame, tracker: str) -> DataFrame:
    """``report_id, record, url`` for ``reports(report_id, at, rule_id, reason)`` with a reason: a log line and a prefilled issue, which nobody is sent."""
    given = reports.where(F.coalesce("reason", F.lit("")) != "")
    record = F.to_json(F.struct(rfc3339(F.col("at")).alias("timestamp"), "rule_id", "reason"))
    body = F.concat(F.lit("Rule: "), "rule_id", F.lit("\n\n"), "reason")
    url = F.concat(F.lit(tracker + "?body="), F.url_encode(body), F.lit("&title="), F.url_encode(F.concat(F.lit("[false-positive] "), "rule_id")))
    return given.select("report_id", record.alias("record"), url.alias("url"))


def marked(markers: DataFrame, passed: DataFrame) -> DataFrame:
    """Markers with the trees of ``passed`` that aren't among them, each once."""
    return markers.select("tree_hash").unionByName(passed.select("tree_hash")).distinct()


def manifest_texts(manifests: DataFrame) -> DataFrame:
    """``change_id, text`` of a manifest's file: its id and paths, quoted."""
    paths = F.array_join(F.transform("paths", lambda p: F.concat(F.lit("  - "), go_quoted(p), F.lit("\n"))), "")
    return manifests.select("change_id", F.concat(F.lit("id: "), go_quoted(F.col("id")), F.lit("\npaths:\n"), paths).alias("text"))


def append(records: DataFrame, folder: str, column: str = "record") -> None:
    """Appends log lines to a folder of JSON lines, which :mod:`palisade.streaming.audit` reads as a stream."""
    records.select(F.col(column).alias("value")).write.mode("append").text(folder)
