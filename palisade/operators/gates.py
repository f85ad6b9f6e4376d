"""Gates: tables of changes, files and added lines in, findings out. No Python runs on rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.globs import matches_any, prefixes, split_glob, to_regex
from palisade.functions.re2 import to_java
from palisade.operators.policy import RULES, Policy, Rule

GATES = ("branch_policy", "diff_budget", "ai_patterns", "scope")
FINDING = ("change_id", "gate_ord", "gate", "rule_id", "severity", "file", "line", "message", "retry_hint", "rule_ord", "suggestion", "fix")
#: Always in scope, whatever a task declares.
IMPLICIT = (".palisade/**",)


def finding(rows: DataFrame, gate: str, **columns: Column) -> DataFrame:
    given = {"gate_ord": F.lit(GATES.index(gate)), "gate": F.lit(gate), "file": F.lit(None).cast("string"), "line": F.lit(None).cast("long"), "rule_ord": F.lit(0), "suggestion": F.lit(None).cast("string"), "fix": F.lit(None).cast("string")} | columns
    return rows.select("change_id", *[given[c].alias(c) for c in FINDING[1:]])


def detect(changes: DataFrame, policy: Policy) -> DataFrame:
    """``changes`` with ``is_agent, prov_source, agent``: environment, trailer, branch prefix, heuristic, first hit wins."""
    lines = F.transform(F.split(F.coalesce("message", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\t\n\f\r\x0B \x85 ]+|[\t\n\f\r\x0B \x85 ]+$", ""))
    credits = F.filter(lines, lambda x: F.lower(x).startswith("co-authored-by:"))
    named = lambda x: F.filter(F.array(*map(F.lit, policy.trailers)), lambda t: F.contains(F.lower(x), F.lower(t)))
    trailer = F.get(F.flatten(F.transform(credits, named)), F.lit(0)) if policy.trailers else F.lit(None).cast("string")
    env = F.regexp_replace(F.coalesce("env_agent", F.lit("")), r"^\s+|\s+$", "")
    prefix = F.coalesce(*[F.when(F.col("branch").startswith(p), F.lit(p)) for p in policy.prefixes if p], F.lit(None).cast("string"))
    text = F.coalesce("message", F.lit(""))
    guess = reduce(lambda a, b: a | b, (F.col("branch").rlike(to_java(p)) | ((text != "") & text.rlike(to_java(p))) for p in policy.heuristics), F.lit(False))
    source = F.when(env != "", "env").when(trailer.isNotNull(), "trailer").when(prefix.isNotNull(), "branch").when(guess, "heuristic").otherwise("none")
    agent = F.when(env != "", env).when(trailer.isNotNull(), trailer).otherwise("")
    return changes.withColumns({"prov_source": source, "agent": agent}).withColumn("is_agent", F.col("prov_source") != "none")


def applicable(changes: DataFrame, policy: Policy) -> DataFrame:
    """Changes that content gates look at."""
    return changes if policy.apply_gates_to == "all-commits" else changes.where("is_agent")


def go_quoted(text: Column) -> Column:
    """Double quotes around, and escapes of quotes, backslashes and ASCII control signs inside; other signs as they are."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (('"', '"'), ("\n", "n"), ("\t", "t"), ("\r", "r")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + name))
    rare = out
    for code in (*range(9), 11, 12, *range(14, 32), 127):
        rare = F.replace(rare, F.lit(chr(code)), F.lit("\\" + {7: "a", 8: "b", 11: "v", 12: "f"}.get(code, f"x{code:02x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), rare).otherwise(out), F.lit('"'))


def branch_policy(changes: DataFrame, policy: Policy) -> DataFrame:
    hit = changes.where(F.col("is_agent") & matches_any(F.col("branch"), policy.protected))
    quoted = go_quoted(F.col("branch"))
    return finding(hit, "branch_policy", rule_id=F.lit("protected-branch"), severity=F.lit("error"), message=F.concat(F.lit("agent commit on protected branch "), quoted), retry_hint=F.concat(F.lit("Move the agent's work off "), quoted, F.lit(" to a branch of its own.")))


def budget_group(path: Column, policy: Policy) -> Column:
    """0 for the global budget, else the place of the first override with a matching pattern."""
    group = F.lit(0)
    for n in range(len(policy.overrides), 0, -1):
        group = F.when(matches_any(path, policy.overrides[n - 1].paths), n).otherwise(group)
    return group


def budget_groups(files: DataFrame, policy: Policy) -> DataFrame:
    """Lines, files and new files of each change and budget group: one aggregation with map-side sums."""
    return files.groupBy("change_id", budget_group(F.col("path"), policy).alias("budget_group")).agg(
        F.sum(F.col("added") + F.col("removed")).alias("lines"), F.count("*").alias("files"), F.count_if(F.col("kind") == "added").alias("new_files")
    )


def diff_budget(files: DataFrame, policy: Policy) -> DataFrame:
    """Up to three findings a group: each measure that is above its limit; a limit of 0 is none, in an override the global one."""
    kinds = (("max-lines", "lines", "max_lines", "changed lines", "line"), ("max-files", "files", "max_files", "changed files", "file"), ("max-new-files", "new_files", "max_new_files", "new files", "new-file"))

    def limit(name: str) -> Column:
        out = F.lit(getattr(policy, name))
        for n, o in enumerate(policy.overrides, 1):
            out = F.when(F.col("budget_group") == n, getattr(o, name) or getattr(policy, name)).otherwise(out)
        return out.cast("long")

    each = F.array(*[F.struct(F.lit(i).alias("rule_ord"), F.lit(rule).alias("rule_id"), F.col(c).alias("actual"), limit(name).alias("allowed"), F.lit(noun).alias("noun"), F.lit(one).alias("one")) for i, (rule, c, name, noun, one) in enumerate(kinds)])
    over = budget_groups(files, policy).select("change_id", "budget_group", F.explode(F.filter(each, lambda x: (x["allowed"] > 0) & (x["actual"] > x["allowed"]))).alias("x")).select("change_id", "budget_group", "x.*")
    where = F.when(F.col("budget_group") == 0, "").otherwise(F.concat(F.lit(" (override "), F.col("budget_group").cast("string"), F.lit(")")))
    over = over.withColumns({"where": where, "head": F.concat(F.col("actual").cast("string"), F.lit(" "), "noun", F.lit(" exceeds the "), F.col("allowed").cast("string"))})
    said = F.concat("head", F.lit(" limit"), "where")
    hint = F.concat(F.lit("Commit in smaller parts: "), "head", F.lit("-"), "one", F.lit(" budget"), "where", F.lit("."))
    return finding(over, "diff_budget", rule_id=F.col("rule_id"), severity=F.lit("error"), message=said, retry_hint=hint, rule_ord=F.col("budget_group") * 3 + F.col("rule_ord"))


def active(policy: Policy, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, Rule]]:
    """Rules with their place; disabled ones go before any regex runs."""
    return [(n, r) for n, r in enumerate(rules) if r.rule_id not in policy.disabled_rules]


def ai_patterns(lines: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, overridden: DataFrame | None = None) -> DataFrame:
    """Every added line that a rule finds, once a rule: the rules are unrolled into one pass over the lines.

    ``overridden(change_id, rule_id)``: rules that a change is let off. Lines are few once a rule has found them, so these go
    afterwards, by an anti join.
    """
    some = active(policy, rules)
    if not some:
        return finding(lines.limit(0), "ai_patterns", rule_id=F.lit(""), severity=F.lit(""), message=F.lit(""), retry_hint=F.lit(""))
    holds = lambda r: reduce(lambda a, b: a | b, (F.contains("text", F.lit(x)) for x in r.needles)) if r.needles else F.lit(True)
    rows = lines.where(reduce(lambda a, b: a | b, map(holds, (r for _, r in some))))
    hits = [F.when(holds(r) & F.col("text").rlike(to_java(r.pattern)), F.struct(F.lit(n).alias("rule_ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(r.retry_hint).alias("retry_hint"), F.lit(r.suggestion or None).cast("string").alias("suggestion"), F.lit(r.fix or None).cast("string").alias("fix"))) for n, r in some]
    found = rows.select("change_id", "path", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("r"))
    found = finding(found, "ai_patterns", file=F.col("path"), line=F.col("line_no").cast("long"), **{c: F.col(f"r.{c}") for c in ("rule_id", "severity", "message", "retry_hint", "rule_ord", "suggestion", "fix")})
    return found if overridden is None else found.join(overridden, ["change_id", "rule_id"], "left_anti").select(found.columns)


def read_glob(glob: str | None) -> tuple[str | None, str | None, str | None]:
    """A pattern's regular expression, literal prefix and kind; nulls for what is no pattern."""
    try:
        return (None, None, None) if glob is None else (to_regex(glob), *split_glob(glob))
    except ValueError:
        return None, None, None


def manifest_patterns(manifests: DataFrame) -> DataFrame:
    """``change_id, glob, regex, prefix, kind`` of ``manifests(change_id, paths)``: each distinct pattern is read once; regex is null for a bad one."""

    @F.pandas_udf("regex string, prefix string, kind string")
    def read(globs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_glob(g) for g in globs], columns=["regex", "prefix", "kind"], dtype=object)

    each = manifests.select("change_id", F.explode("paths").alias("glob"))
    return each.join(each.select("glob").distinct().withColumn("r", read("glob")).select("glob", "r.*"), "glob").select("change_id", "glob", "regex", "prefix", "kind")


def within(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``change_id, path`` of the files that a pattern of their change matches.

    A path meets only patterns whose literal beginning is one of its own: an equality, so a manifest of any length costs what matches it, and
    only what is left of a pattern with wildcards is tried as a regular expression.
    """
    paths = files.select("change_id", "path").distinct().withColumn("prefix", F.explode(prefixes(F.col("path"))))
    both = paths.join(patterns.where("regex is not null").select("change_id", "prefix", "kind", "regex").distinct(), ["change_id", "prefix"])
    return both.where("kind = 'below' or (kind = 'exact' and prefix = path) or (kind = 'regex' and path rlike regex)").select("change_id", "path").distinct()


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """``change_id, gate, error`` of manifests that can't be read: the gate fails, it doesn't pass."""
    bad = manifest_patterns(manifests).where("regex is null").groupBy("change_id").agg(F.min("glob").alias("glob"))
    return bad.select("change_id", F.lit("scope").alias("gate"), F.concat(F.lit("bad pattern in the manifest: "), "glob").alias("error"))


def scope(files: DataFrame, policy: Policy, manifests: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Files outside the declared paths; without any declared paths nothing, or one finding a change if a manifest is required.

    ``manifests(change_id, paths)`` gives each change patterns of its own, which are joined by change.
    """
    open_ = files.where(~matches_any(F.col("path"), (*IMPLICIT, *policy.allow_always)))
    if manifests is not None:
        declared = open_.join(manifests.select("change_id").distinct(), "change_id", "left_semi")
        out = declared.join(within(declared, manifest_patterns(manifests)), ["change_id", "path"], "left_anti")
    elif policy.declared is None:
        if not policy.require_manifest or changes is None:
            return finding(files.limit(0), "scope", rule_id=F.lit(""), severity=F.lit(""), message=F.lit(""), retry_hint=F.lit(""))
        return finding(changes, "scope", rule_id=F.lit("missing-manifest"), severity=F.lit("error"), message=F.lit("no task scope is declared"), retry_hint=F.lit("Declare the paths of the task."))
    else:
        out = open_.where(~matches_any(F.col("path"), policy.declared))
    said = F.concat("path", F.lit(" is not in the task's scope"))
    return finding(out, "scope", rule_id=F.lit("out-of-scope"), severity=F.lit("error"), file=F.col("path"), message=said, retry_hint=F.concat(said, F.lit("; commit it by itself.")))


def rule_table(spark: SparkSession, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rules as data, with effective severity, whether they are on, and which of their own examples misbehave."""
    rows = [(n, r.rule_id, r.pattern, to_java(r.pattern), policy.severities.get(f"ai_patterns/{r.rule_id}", r.severity), r.rule_id not in policy.disabled_rules, list(r.positives), list(r.negatives)) for n, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_ord int, rule_id string, pattern string, java string, severity string, enabled boolean, positives array<string>, negatives array<string>")
    missed = F.expr("filter(positives, x -> not x rlike java)")
    wrong = F.expr("filter(negatives, x -> x rlike java)")
    lacking = F.when(F.size("positives") == 0, 1).otherwise(0) + F.when(F.size("negatives") == 0, 1).otherwise(0)
    return table.withColumn("failures", F.size(missed) + F.size(wrong) + lacking).drop("java")
