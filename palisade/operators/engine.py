"""The pipeline over findings: union, links, severities, stop at the first block, verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scans import running
from palisade.operators import gates
from palisade.operators.policy import Policy

DOCS = "https://docs.example.org/rules/"


def with_docs(findings: DataFrame, base: str = DOCS) -> DataFrame:
    """A page for each finding that has a gate and a rule and no link yet."""
    known = (F.coalesce("gate", F.lit("")) != "") & (F.coalesce("rule_id", F.lit("")) != "")
    page = F.concat(F.lit(base), F.translate("gate", "_", "-"), F.lit("-"), F.translate("rule_id", "/", "-"), F.lit(".md"))
    given = F.nullif(F.col("docs_url"), F.lit("")) if "docs_url" in findings.columns else F.lit(None).cast("string")
    return findings.withColumn("docs_url", F.coalesce(given, F.when(known, page), F.lit("")))


def with_severities(findings: DataFrame, severities: dict[str, str]) -> DataFrame:
    """Severities by ``gate/rule_id``, before anything is decided; no column is touched without any."""
    if not severities:
        return findings
    table = F.create_map(*[F.lit(x) for pair in severities.items() for x in pair])
    return findings.withColumn("severity", F.coalesce(F.try_element_at(table, F.concat("gate", F.lit("/"), "rule_id")), "severity"))


def until_first_block(findings: DataFrame) -> DataFrame:
    """Findings of a change's gates up to and with the first that blocks."""
    earlier = Window.partitionBy("change_id").orderBy("gate_ord").rangeBetween(Window.unboundedPreceding, -1)
    blocked = F.max((F.col("severity") == "error").cast("int")).over(earlier)
    return findings.withColumn("_blocked", F.coalesce(blocked, F.lit(0))).where("_blocked = 0").drop("_blocked")


@dataclass(frozen=True)
class Tables:
    """What gates look at, each keyed by ``change_id``; the last two may be lacking."""

    changes: DataFrame
    files: DataFrame
    lines: DataFrame
    manifests: DataFrame | None = None
    overridden: DataFrame | None = None


#: A gate: tables and policy in, findings out. Any function of this shape can be given to :func:`evaluate`.
Gate = Callable[[Tables, Policy], DataFrame]
STANDARD: tuple[Gate, ...] = (
    lambda t, p: gates.branch_policy(t.changes, p),
    lambda t, p: gates.diff_budget(t.files, p),
    lambda t, p: gates.ai_patterns(t.lines, p, overridden=t.overridden),
    lambda t, p: gates.scope(t.files, p, t.manifests, t.changes),
)


def evaluate(tables: Tables, policy: Policy, run: tuple[Gate, ...] = STANDARD) -> DataFrame:
    """All findings of all changes in one plan: the gates' unions need no shuffle between them.

    Content gates look at agents' changes only, unless the policy says all commits. Rules that a change is let off
    (:func:`override_ids`) find nothing in it.
    """
    changes, files, lines = gates.detect(tables.changes, policy), tables.files, tables.lines
    if policy.apply_gates_to != "all-commits":
        some = gates.applicable(changes, policy).select("change_id")
        files, lines = files.join(some, "change_id", "left_semi"), lines.join(some, "change_id", "left_semi")
    overridden = tables.overridden if tables.overridden is not None else override_ids(changes, policy.mode)
    seen = replace(tables, changes=changes, files=files, lines=lines, overridden=overridden)
    found = with_severities(with_docs(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (gate(seen, policy) for gate in run))), policy.severities)
    return until_first_block(found) if policy.stop_on_first_block else found


def verdicts(changes: DataFrame, findings: DataFrame, mode: str, errors: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """One row a change, also without findings: counts by severity, gate errors, whether it blocks, result and exit code.

    ``errors(change_id, gate, error)``: gates that failed, which block as findings of severity error do. ``refused(change_id)``:
    changes that could not be looked at at all, whose exit code is 2.
    """
    number = lambda s: F.count_if(F.col("severity") == s)
    counts = findings.groupBy("change_id").agg(F.count("*").alias("n_findings"), number("error").alias("n_errors"), number("warn").alias("n_warnings"), number("info").alias("n_info"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = changes.select("change_id").join(counts, "change_id", "left")
    if errors is None:
        out = out.withColumn("n_gate_errors", F.lit(0))
    else:
        out = out.join(errors.groupBy("change_id").agg(F.count("*").alias("n_gate_errors")), "change_id", "left")
    out = out.select("change_id", *[zero(c) for c in ("n_findings", "n_errors", "n_warnings", "n_info", "n_gate_errors")])
    serious = (F.col("n_errors") > 0) | (F.col("n_gate_errors") > 0)
    blocking = serious & F.lit(mode != "warn")
    result = F.when(blocking, "blocked").when(serious, "warned").otherwise("passed")
    out = out.withColumns({"blocking": blocking, "result": result, "exit_code": blocking.cast("int")})
    if refused is None:
        return out
    out = out.join(refused.select("change_id", F.lit(True).alias("_refused")).distinct(), "change_id", "left")
    return out.withColumn("exit_code", F.when(F.col("_refused"), 2).otherwise(F.col("exit_code"))).drop("_refused")


def retry_hints(findings: DataFrame) -> DataFrame:
    """Each change's different hints in order of first occurrence: ``change_id, hint_ord, retry_hint``."""
    place = F.struct("gate_ord", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), "rule_ord")
    first = findings.where(F.coalesce("retry_hint", F.lit("")) != "").groupBy("change_id", "retry_hint").agg(F.min(place).alias("at"))
    order = Window.partitionBy("change_id").orderBy("at", "retry_hint")
    return first.select("change_id", F.row_number().over(order).alias("hint_ord"), "retry_hint")


def tickets(changes: DataFrame) -> DataFrame:
    """``change_id, ticket``: the key that starts the branch's last segment, in capitals; without one the change is left out."""
    last = F.element_at(F.split("branch", "/"), -1)
    key = F.regexp_extract(last, r"^([A-Za-z]{2,10}-[0-9]{1,6})(?:[^0-9A-Za-z]|\z)", 1)
    return changes.select("change_id", F.upper(key).alias("ticket")).where("ticket <> ''")


def override_ids(changes: DataFrame, mode: str, key: str = "Policy-Override:") -> DataFrame:
    """``change_id, rule_id`` that a change is let off, each once: an id for each trailer, as written, and the comma-separated
    ids of ``env_override``, if there is such a column. None in strict mode."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.transform(F.split(F.coalesce("message", F.lit("")), "\n"), trimmed)
    ids = F.transform(F.filter(lines, lambda x: x.startswith(key)), lambda x: trimmed(F.substring(x, F.lit(len(key) + 1), F.length(x))))
    if "env_override" in changes.columns:
        ids = F.concat(ids, F.transform(F.split(F.coalesce("env_override", F.lit("")), ","), trimmed))
    found = changes.where(F.lit(mode != "ci_strict")).select("change_id", F.explode(ids).alias("rule_id"))
    return found.where("rule_id <> ''").distinct()


def merged_overrides(policy: Policy, overridden: DataFrame, rules: DataFrame) -> DataFrame:
    """``change_id, rule_id, off_by`` of the rules that are off for a change: by the policy, or by an override of its own."""
    known = overridden.join(rules.select("rule_id"), "rule_id", "left_semi")
    by = F.when(F.col("rule_id").isin(*policy.disabled_rules), "policy").otherwise("override") if policy.disabled_rules else F.lit("override")
    return known.select("change_id", "rule_id", by.alias("off_by"))


def unverified(changes: DataFrame, markers: DataFrame) -> DataFrame:
    """Commits, merges left out, whose tree no passed check has marked."""
    return changes.where("not is_merge").join(markers, "tree_hash", "left_anti")


def bypassed(changes: DataFrame, bypass: DataFrame, mode: str) -> DataFrame:
    """Commits whose gates a one-shot token skips: the first of an author after the token was armed; arming again before it changes nothing."""
    if mode == "ci_strict":
        return changes.limit(0)
    armed = bypass.select("branch", F.col("ts").alias("at"), F.lit(None).cast("long").alias("change_id"))
    events = changes.select("branch", F.col("committed_at").alias("at"), "change_id").unionByName(armed)
    # A branch may hold nearly all events: commits before an event are counted day by day, not in one window.
    events = events.withColumns({"_commit": F.col("change_id").isNotNull().cast("long"), "_order": F.struct("at", F.col("change_id").isNotNull().alias("c"), "change_id")})
    events = running(events, ["branch"], "_order", F.to_date("at"), _n=("sum", F.col("_commit"))).withColumn("_n", F.col("_n") - F.col("_commit"))
    used = events.where("_commit = 1").join(events.where("_commit = 0").select("branch", "_n").distinct(), ["branch", "_n"], "left_semi")
    return changes.join(used.select("change_id"), "change_id", "left_semi")
