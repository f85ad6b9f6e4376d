"""The registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators import calibrate, engine, gates, reports
from palisade.operators.policy import RULES, BudgetOverride, Policy
from palisade.sources import adapters as A
from palisade.sources import patches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

POLICY = Policy(
    max_lines=120, max_files=5, max_new_files=3, overrides=(BudgetOverride(("promo/**", "**/*.lock"), max_lines=10_000),),
    heuristics=("bot/",), allow_always=("**/*.lock",), declared=("promo/**", "large/**"), severities={"ai_patterns/no-broad-catch": "error", "diff_budget/max-files": "warn"},
)


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


DETECT = """detected AS (SELECT *, CASE WHEN env_agent <> '' THEN 'env' WHEN lower(message) LIKE '%co-authored-by: cursor%' THEN 'trailer'
    WHEN branch LIKE 'agent/%' OR branch LIKE 'ai/%' THEN 'branch' WHEN regexp_matches(branch, 'bot/') OR regexp_matches(message, 'bot/') THEN 'heuristic' ELSE 'none' END AS prov_source FROM changes)"""
GROUPS = """groups AS (SELECT change_id, CASE WHEN path LIKE 'promo/%' OR path LIKE '%.lock' THEN 1 ELSE 0 END AS budget_group, CAST(sum(added + removed) AS BIGINT) AS lines,
    count(*) AS files, count(*) FILTER (kind = 'added') AS new_files FROM files GROUP BY 1, 2)"""
OVER = """over AS (SELECT change_id, budget_group, rule_ord, rule_id, actual, allowed, noun FROM (
    SELECT change_id, budget_group, 0 AS rule_ord, 'max-lines' AS rule_id, lines AS actual, CASE budget_group WHEN 1 THEN 10000 ELSE 120 END AS allowed, 'changed lines' AS noun FROM groups
    UNION ALL SELECT change_id, budget_group, 1, 'max-files', files, 5, 'changed files' FROM groups UNION ALL SELECT change_id, budget_group, 2, 'max-new-files', new_files, 3, 'new files' FROM groups) WHERE actual > allowed)"""
HEAD_SAID = "CAST(actual AS VARCHAR) || ' ' || noun || ' exceeds the ' || CAST(allowed AS VARCHAR)"
WHERE_SAID = "CASE budget_group WHEN 0 THEN '' ELSE ' (override ' || CAST(budget_group AS VARCHAR) || ')' END"
SAID = f"{HEAD_SAID} || ' limit' || {WHERE_SAID}"
HINTED = f"'Commit in smaller parts: ' || {HEAD_SAID} || '-' || CASE rule_id WHEN 'max-lines' THEN 'line' WHEN 'max-files' THEN 'file' ELSE 'new-file' END || ' budget' || {WHERE_SAID} || '.'"
LET_OFF = """overridden AS (SELECT DISTINCT change_id, rule_id FROM (SELECT change_id, trim(substr(l, 17)) AS rule_id FROM (SELECT change_id, trim(unnest(string_split(message, chr(10)))) AS l FROM changes)
    WHERE l LIKE 'Policy-Override:%' UNION ALL SELECT change_id, trim(unnest(string_split(env_override, ','))) FROM changes) WHERE rule_id <> '')"""
PATTERNS = [r.pattern.replace("'", "''") for r in RULES]
HITS = " UNION ALL ".join(f"SELECT change_id, path, line_no, {n} AS rule_ord, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.message}' AS message, '{r.retry_hint}' AS retry_hint FROM added_lines WHERE regexp_matches(text, '{p}')" for n, (r, p) in enumerate(zip(RULES, PATTERNS, strict=True)))
FOUND = f"""found AS (
    SELECT change_id, 0 AS gate_ord, 'branch_policy' AS gate, 'protected-branch' AS rule_id, 'error' AS severity, NULL AS file, CAST(NULL AS BIGINT) AS line, 'agent commit on protected branch "' || branch || '"' AS message,
           'Move the agent''s work off "' || branch || '" to a branch of its own.' AS retry_hint, 0 AS rule_ord FROM detected WHERE prov_source <> 'none' AND (branch = 'main' OR regexp_full_match(branch, 'release/[^/]*'))
    UNION ALL SELECT change_id, 1, 'diff_budget', rule_id, CASE rule_id WHEN 'max-files' THEN 'warn' ELSE 'error' END, NULL, NULL, {SAID}, {HINTED}, budget_group * 3 + rule_ord FROM over
    UNION ALL SELECT change_id, 2, 'ai_patterns', rule_id, 'error', path, line_no, message, retry_hint, rule_ord FROM ({HITS}) h
        WHERE NOT EXISTS (SELECT 1 FROM overridden o WHERE o.change_id = h.change_id AND o.rule_id = h.rule_id)
    UNION ALL SELECT change_id, 3, 'scope', 'out-of-scope', 'error', path, NULL, path || ' is not in the task''s scope', path || ' is not in the task''s scope; commit it by itself.', 0 FROM files
        WHERE NOT (path LIKE '%.lock' OR path LIKE 'promo/%' OR path LIKE 'large/%' OR path LIKE '.palisade/%'))"""
ALL = f"WITH {A.CHANGES_SQL}, {A.FILES_SQL}, {A.LINES_SQL}, {DETECT}, {GROUPS}, {OVER}, {LET_OFF}, {FOUND}"
STRICT = ALL.replace(LET_OFF, "overridden AS (SELECT 0 AS change_id, '' AS rule_id WHERE FALSE)")
#: Change and document ids overlap, so every gate meets in some changes.
STOPPED = """stopped AS (SELECT * FROM (SELECT *, coalesce(max(CASE severity WHEN 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY change_id ORDER BY gate_ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM found) WHERE b = 0)"""


def findings(spark: SparkSession, sf_dir: str, policy: Policy = POLICY) -> DataFrame:
    return engine.evaluate(engine.Tables(A.changes(spark, sf_dir), A.files(spark, sf_dir), A.added_lines(spark, sf_dir)), policy)


@query("file_change_join", f"""WITH {A.FILES_SQL}, parts AS (SELECT l_orderkey AS change_id, {A.PATH} AS path, count(*) AS n_parts FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10 GROUP BY 1, 2)
    SELECT f.change_id, f.path, CASE WHEN f.kind = 'added' THEN 'added' ELSE 'modified' END AS kind, f.added, f.removed, coalesce(n_parts, 0) AS n_parts FROM files f LEFT JOIN parts USING (change_id, path)""")  # fmt: skip
def file_change_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.files(spark, sf_dir)
    kinds = counts.where("kind = 'added'").select("change_id", "path", F.col("kind").alias("named"))
    parts = A.file_parts(spark, sf_dir).where("added > 10").groupBy("change_id", "path").agg(F.count("*").alias("n_parts"))
    both = counts.drop("kind").join(kinds, ["change_id", "path"], "left").join(parts, ["change_id", "path"], "left")
    return both.select("change_id", "path", F.coalesce("named", F.lit("modified")).alias("kind"), "added", "removed", F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


@query("budget_groups", f"WITH {A.FILES_SQL}, {GROUPS} SELECT * FROM groups")
def budget_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.budget_groups(A.files(spark, sf_dir), POLICY)


@query("diff_budget_findings", f"WITH {A.FILES_SQL}, {GROUPS}, {OVER} SELECT change_id, rule_id, 'error' AS severity, {SAID} AS message, budget_group * 3 + rule_ord AS rule_ord FROM over")
def diff_budget_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.diff_budget(A.files(spark, sf_dir), POLICY).select("change_id", "rule_id", "severity", "message", "rule_ord")


@query("provenance_detect", f"""WITH {A.CHANGES_SQL}, {DETECT} SELECT change_id, branch, prov_source, CASE prov_source WHEN 'env' THEN 'Devin' WHEN 'trailer' THEN 'Cursor' ELSE '' END AS agent, prov_source <> 'none' AS is_agent FROM detected""")
def provenance_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.detect(A.changes(spark, sf_dir), POLICY).select("change_id", "branch", "prov_source", "agent", "is_agent")


@query("branch_policy_findings", f"""WITH {A.CHANGES_SQL}, {DETECT} SELECT change_id, 'protected-branch' AS rule_id, 'agent commit on protected branch "' || branch || '"' AS message FROM detected WHERE prov_source <> 'none' AND (branch = 'main' OR regexp_full_match(branch, 'release/[^/]*'))""")
def branch_policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.branch_policy(gates.detect(A.changes(spark, sf_dir), POLICY), POLICY).select("change_id", "rule_id", "message")


@query("scope_findings", f"WITH {A.FILES_SQL} SELECT change_id, path AS file, path || ' is not in the task''s scope' AS message FROM files WHERE NOT (path LIKE '%.lock' OR path LIKE 'promo/%' OR path LIKE 'large/%' OR path LIKE '.palisade/%')")
def scope_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.scope(A.files(spark, sf_dir), POLICY).select("change_id", "file", "message")


@query("scope_no_manifest", f"WITH {A.CHANGES_SQL} SELECT change_id, 'missing-manifest' AS rule_id, 'no task scope is declared' AS message FROM changes")
def scope_no_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = replace(POLICY, declared=None, require_manifest=True)
    return gates.scope(A.files(spark, sf_dir), policy, changes=A.changes(spark, sf_dir)).select("change_id", "rule_id", "message")


@query("scope_by_manifest", f"""WITH {A.FILES_SQL}, {A.CHANGES_SQL} SELECT change_id, path AS file FROM files JOIN changes USING (change_id) WHERE change_id % 5 IN (0, 1) AND path NOT LIKE '%.lock' AND path NOT LIKE '.palisade/%'
    AND NOT (path LIKE 'standard/%' OR (change_id % 5 = 1 AND path LIKE 'economy/%'))""")  # fmt: skip
def scope_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.when(F.col("change_id") % 5 == 1, F.array(F.lit("standard/**"), F.lit("economy/**"))).otherwise(F.array(F.lit("standard/**")))
    manifests = A.changes(spark, sf_dir).where("change_id % 5 in (0, 1)").select("change_id", paths.alias("paths"))
    return gates.scope(A.files(spark, sf_dir), POLICY, manifests).select("change_id", "file")


@query("ai_pattern_findings", f"WITH {A.LINES_SQL} SELECT change_id, path AS file, line_no AS line, rule_id, severity FROM ({HITS})")
def ai_pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.ai_patterns(A.added_lines(spark, sf_dir), POLICY).select("change_id", "file", "line", "rule_id", "severity")


@query("severity_overrides", f"{ALL} SELECT gate, rule_id, severity, count(*) AS n FROM found GROUP BY 1, 2, 3")
def severity_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("gate", "rule_id", "severity").agg(F.count("*").alias("n"))


@query("docs_urls", f"{ALL} SELECT change_id, gate_ord, rule_ord, file, line, '{engine.DOCS}' || replace(gate, '_', '-') || '-' || replace(rule_id, '/', '-') || '.md' AS docs_url FROM found")
def docs_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("change_id", "gate_ord", "rule_ord", "file", "line", "docs_url")


@query("stop_on_first_block", f"{ALL}, {STOPPED} SELECT change_id, gate_ord, rule_id, severity, file, line FROM stopped")
def stop_on_first_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir, replace(POLICY, stop_on_first_block=True)).select("change_id", "gate_ord", "rule_id", "severity", "file", "line")


def verdict_sql(mode: str) -> str:
    blocks = "FALSE" if mode == "warn" else "n_errors > 0"
    return f"""{STRICT if mode == 'ci_strict' else ALL}, counts AS (SELECT c.change_id, count(f.change_id) AS n_findings, count(*) FILTER (f.severity = 'error') AS n_errors, count(*) FILTER (f.severity = 'warn') AS n_warnings,
        count(*) FILTER (f.severity = 'info') AS n_info, CAST(0 AS BIGINT) AS n_gate_errors FROM changes c LEFT JOIN found f ON c.change_id = f.change_id GROUP BY 1)
        SELECT *, {blocks} AS blocking, CASE WHEN {blocks} THEN 'blocked' WHEN n_errors > 0 THEN 'warned' ELSE 'passed' END AS result, CASE WHEN {blocks} THEN 1 ELSE 0 END AS exit_code FROM counts"""


def verdicts_in(mode: str) -> Query:
    return lambda spark, sf_dir: engine.verdicts(A.changes(spark, sf_dir), findings(spark, sf_dir, replace(POLICY, mode=mode)), mode)


for _mode, _name in (("enforce", "change_verdicts"), ("warn", "change_verdicts_warn"), ("ci_strict", "change_verdicts_strict")):
    query(_name, verdict_sql(_mode))(verdicts_in(_mode))


@query("per_commit_vs_range", f"""WITH {A.FILES_SQL}, each AS (SELECT change_id, sum(added + removed) AS lines FROM files GROUP BY 1)
    SELECT change_id // 100 AS range_id, count(*) AS n_commits, CAST(sum(lines) AS BIGINT) AS range_sum, count(*) FILTER (lines > 120) AS commits_over, sum(lines) > 1200 AS range_over FROM each GROUP BY 1""")  # fmt: skip
def per_commit_vs_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = A.files(spark, sf_dir).groupBy("change_id").agg(F.sum(F.col("added") + F.col("removed")).alias("lines"))
    total = F.sum("lines")
    return each.groupBy(F.expr("change_id div 100").alias("range_id")).agg(F.count("*").alias("n_commits"), total.alias("range_sum"), F.count_if(F.col("lines") > 120).alias("commits_over"), (total > 1200).alias("range_over"))


@query("retry_hint_digest", f"""{ALL}, firsts AS (SELECT change_id, retry_hint, min(struct_pack(a := gate_ord, b := coalesce(file, ''), c := coalesce(line, 0), d := rule_ord)) AS place FROM found GROUP BY 1, 2)
    SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY place, retry_hint) AS INTEGER) AS hint_ord, retry_hint FROM firsts""")  # fmt: skip
def retry_hint_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.retry_hints(findings(spark, sf_dir))


@query("sarif_results", f"{ALL} SELECT change_id, gate || '/' || rule_id AS rule, CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END AS level, message, coalesce(file, '.palisade.yml') AS uri, greatest(coalesce(line, 1), 1) AS start_line FROM found")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(findings(spark, sf_dir))


@query("findings_by_gate", f"{ALL} SELECT gate, count(*) AS n_findings, count(DISTINCT change_id) AS n_changes, count(DISTINCT rule_id) AS n_rules FROM found GROUP BY 1")
def findings_by_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    return found.groupBy("gate").agg(F.count("*").alias("n_findings"), F.countDistinct("change_id").alias("n_changes"), F.countDistinct("rule_id").alias("n_rules"))


@query("rules_listing", f"WITH {A.LINES_SQL}, hits AS ({HITS}) SELECT r.rule_id, r.severity, TRUE AS enabled, 0 AS failures, count(h.rule_id) AS n_hits FROM (VALUES ('no-new-lint-suppressions', 'error'), ('no-broad-catch', 'error')) r(rule_id, severity) LEFT JOIN hits h ON r.rule_id = h.rule_id GROUP BY 1, 2")
def rules_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = gates.ai_patterns(A.added_lines(spark, sf_dir), POLICY).groupBy("rule_id").agg(F.count("*").alias("n_hits"))
    table = gates.rule_table(spark, POLICY).join(hits, "rule_id", "left")
    return table.select("rule_id", "severity", "enabled", "failures", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


@query("ticket_refs", f"WITH {A.CHANGES_SQL}, t AS (SELECT change_id, upper(regexp_extract(list_extract(string_split(branch, '/'), -1), '^([A-Za-z]{{2,10}}-[0-9]{{1,6}})([^0-9A-Za-z]|$)', 1)) AS ticket FROM changes) SELECT * FROM t WHERE ticket <> ''")
def ticket_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.tickets(A.changes(spark, sf_dir))


@query("override_trailers", f"WITH {A.CHANGES_SQL}, {LET_OFF} SELECT * FROM overridden")
def override_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.override_ids(A.changes(spark, sf_dir), POLICY.mode)


@query("unverified_commits", f"WITH {A.CHANGES_SQL} SELECT change_id, tree_hash FROM changes c WHERE NOT is_merge AND NOT EXISTS (SELECT 1 FROM changes m WHERE m.change_id % 3 <> 0 AND m.tree_hash = c.tree_hash)")
def unverified_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.unverified(A.changes(spark, sf_dir), A.markers(spark, sf_dir)).select("change_id", "tree_hash")


@query("gate_filtering", f"WITH {A.CHANGES_SQL}, {DETECT} SELECT change_id, prov_source FROM detected WHERE prov_source <> 'none'")
def gate_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = replace(POLICY, apply_gates_to="agent-only")
    return gates.applicable(gates.detect(A.changes(spark, sf_dir), policy), policy).select("change_id", "prov_source")


@query("bypass_one_shot", f"""WITH {A.CHANGES_SQL}, e AS (SELECT branch, committed_at AS moment, change_id FROM changes UNION ALL SELECT branch, committed_at - INTERVAL 1 HOUR, NULL FROM changes WHERE change_id % 29 = 0),
    w AS (SELECT change_id, branch, lag(coalesce(change_id, -1)) OVER (PARTITION BY branch ORDER BY moment, change_id NULLS FIRST) AS before FROM e) SELECT change_id, branch FROM w WHERE change_id IS NOT NULL AND before = -1""")  # fmt: skip
def bypass_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.bypassed(A.changes(spark, sf_dir), A.bypass_log(spark, sf_dir), POLICY.mode).select("change_id", "branch")


@query("patch_lines", f"WITH {A.LINES_SQL} SELECT change_id, path, '+' AS op, line_no + 10 AS line_no, text FROM added_lines")
def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as patches that add all their lines behind a context line, then read back."""
    lines = A.added_lines(spark, sf_dir)
    whole = lines.groupBy("change_id", "path").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    n = F.size("x").cast("string")
    head = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -10,1 +10,"), (F.size("x") + 1).cast("string"), F.lit(" @@ "), n, F.lit("\n context\n+"))
    text = F.concat(head, F.array_join(F.transform("x", lambda y: y["text"]), "\n+"), F.lit("\n"))
    return patches.patch_lines(whole.select("change_id", text.alias("text")), "change_id")


@query("numstat_decode", f"WITH {A.FILES_SQL} SELECT change_id, path, CASE kind WHEN 'renamed' THEN 'old/' || path END AS old_path, CASE kind WHEN 'deleted' THEN 0 ELSE added END AS added, CASE kind WHEN 'deleted' THEN 0 ELSE removed END AS removed, kind = 'deleted' AS is_binary FROM files")
def numstat_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as NUL-delimited listings, one a change, then read back; deleted ones stand for binaries."""
    number = lambda c: F.when(F.col("kind") == "deleted", F.lit("-")).otherwise(F.col(c).cast("string"))
    name = F.when(F.col("kind") == "renamed", F.concat(F.lit("\x00old/"), "path", F.lit("\x00"), "path")).otherwise(F.col("path"))
    rows = A.files(spark, sf_dir).select("change_id", F.concat(number("added"), F.lit("\t"), number("removed"), F.lit("\t"), name, F.lit("\x00")).alias("t"))
    return patches.numstat(rows.groupBy("change_id").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("text")), "change_id")


@query("budget_fit_p75", f"""WITH {A.FILES_SQL}, s AS (SELECT change_id, split_part(path, '/', 1) AS area, CAST(sum(added + removed) AS BIGINT) AS lines FROM files GROUP BY 1, 2)
    SELECT area, quantile_cont(lines, 0.75) AS p75, count(*) AS n_changes, CAST(2 * quantile_cont(lines, 0.75) AS DOUBLE) AS suggested FROM s GROUP BY 1""")  # fmt: skip
def budget_fit_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.files(spark, sf_dir).withColumn("area", F.substring_index("path", "/", 1))
    return calibrate.fitted_budget(files, "area")


HEAD = "head AS (SELECT change_id, path, line_no, CASE WHEN line_no % 3 = 0 THEN raw ELSE text END AS text FROM (SELECT a.*, list_extract(string_split(d.text, chr(10)), line_no) AS raw FROM added_lines a JOIN documents d ON d.doc_id = a.change_id) WHERE line_no % 5 <> 0)"


@query("rule_precision_audit", f"""WITH {A.LINES_SQL}, {HEAD}, hits AS (SELECT h.*, a.text FROM ({HITS}) h JOIN added_lines a USING (change_id, path, line_no)),
    r AS (SELECT rule_id, count(*) AS samples, avg(CASE WHEN head.text IS NULL OR head.text <> hits.text THEN 1.0 ELSE 0.0 END) AS rate FROM hits LEFT JOIN head USING (change_id, path, line_no) GROUP BY 1)
    SELECT rule_id, samples, round(rate, 9) AS acted_rate, samples >= 20 AND rate <= 0.3 AS demote FROM r""")  # fmt: skip
def rule_precision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the head every fifth line is gone and every third is as the document has it."""
    lines = A.added_lines(spark, sf_dir)
    raw = A.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("change_id"), F.posexplode(F.split("text", "\n", -1)).alias("p", "raw")).withColumn("line_no", (F.col("p") + 1).cast("long")).drop("p")
    hits = gates.ai_patterns(lines, POLICY).select("change_id", F.col("file").alias("path"), F.col("line").alias("line_no"), "rule_id").join(lines, ["change_id", "path", "line_no"])
    few = hits.select("change_id", "line_no").distinct()
    head = lines.join(few, ["change_id", "line_no"], "left_semi").join(raw.join(few, ["change_id", "line_no"], "left_semi"), ["change_id", "line_no"]).where("line_no % 5 <> 0").withColumn("text", F.when(F.col("line_no") % 3 == 0, F.col("raw")).otherwise(F.col("text")))
    return calibrate.precision(hits, head, 20, 0.3).withColumn("acted_rate", F.round("acted_rate", 9))


@query("census_ratchet", f"""WITH {A.LINES_SQL}, hits AS ({HITS}), now AS (SELECT rule_id, split_part(path, '/', 1) AS lang, count(*) AS n FROM hits GROUP BY 1, 2), before AS (SELECT rule_id, split_part(path, '/', 1) AS lang, count(*) AS n FROM hits WHERE line_no % 4 <> 0 GROUP BY 1, 2)
    SELECT rule_id, lang, coalesce(now.n, 0) AS n_now, coalesce(before.n, 0) AS n_before, coalesce(now.n, 0) > coalesce(before.n, 0) AS failed FROM now FULL JOIN before USING (rule_id, lang)""")  # fmt: skip
def census_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = gates.ai_patterns(A.added_lines(spark, sf_dir), POLICY).withColumn("lang", F.substring_index("file", "/", 1))
    count = lambda df: df.groupBy("rule_id", "lang").agg(F.count("*").alias("n"))
    return calibrate.ratchet(count(hits), count(hits.where("line % 4 <> 0")), "rule_id", "lang")


@query("naming_drift", f"""WITH {A.FILES_SQL}, s AS (SELECT change_id, path, split_part(path, '/', 1) AS area, CASE WHEN regexp_matches(path, '_[a-z0-9]+\\.go$') THEN 'snake_go' ELSE 'other' END AS form FROM files),
    c AS (SELECT area, form, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT area, arg_max(form, struct_pack(a := n, b := form)) AS dominant, max(n) AS n_dominant, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1)
    SELECT s.change_id, s.path, s.form, dominant FROM s JOIN t USING (area) WHERE n_dominant >= 0.8 * total AND s.form <> dominant""")  # fmt: skip
def naming_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("path").rlike(r"_[a-z0-9]+\.go\z"), "snake_go").otherwise("other")
    rows = A.files(spark, sf_dir).select("change_id", "path", F.substring_index("path", "/", 1).alias("area"), form.alias("form"))
    return rows.join(calibrate.dominant(rows, "area", "form", 0.8), "area").where("form <> dominant").select("change_id", "path", "form", "dominant")


@query("extension_drift", f"""WITH {A.FILES_SQL}, s AS (SELECT change_id, path, split_part(path, '/', 1) AS area, regexp_extract(path, '\\.([a-z]+)$', 1) AS form FROM files), c AS (SELECT area, form, count(*) AS n FROM s GROUP BY 1, 2),
    t AS (SELECT area, max(n) AS n_dominant, CAST(sum(n) AS BIGINT) AS total, arg_max(form, struct_pack(a := n, b := form)) AS dominant FROM c GROUP BY 1) SELECT area, dominant, n_dominant, total FROM t WHERE n_dominant >= 0.8 * total""")  # fmt: skip
def extension_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("area"), F.regexp_extract("path", r"\.([a-z]+)\z", 1).alias("form"))
    return calibrate.dominant(rows, "area", "form", 0.8)


@query("diff_coverage", f"""WITH {A.LINES_SQL}, c AS (SELECT change_id, line_no, (change_id * 7 + line_no) % 10 < 7 AS hit FROM added_lines WHERE line_no % 2 = 1)
    SELECT change_id, count(*) AS coverable, count(*) FILTER (hit) AS covered, count(*) FILTER (hit) * 100 < count(*) * 70 AS failed FROM added_lines JOIN c USING (change_id, line_no) GROUP BY 1""")  # fmt: skip
def diff_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.added_lines(spark, sf_dir)
    covered = lines.where("line_no % 2 = 1").select("change_id", "path", "line_no", ((F.col("change_id") * 7 + F.col("line_no")) % 10 < 7).alias("hit"))
    return calibrate.coverage(lines, covered, 70)


@query("audit_log_hours", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1, 2""")
def audit_log_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return log.groupBy("hour", "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query("agent_share_by_month", f"WITH {A.CHANGES_SQL}, {DETECT}, m AS (SELECT date_trunc('month', committed_at) AS month, prov_source FROM detected) SELECT CAST(month AS TIMESTAMP) AS month, prov_source, count(*) AS n, sum(count(*)) OVER (PARTITION BY month)::BIGINT AS n_month FROM m GROUP BY 1, 2, m.month")
def agent_share_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.detect(A.changes(spark, sf_dir), POLICY).groupBy(F.date_trunc("month", "committed_at").alias("month"), "prov_source").agg(F.count("*").alias("n"))
    return found.withColumn("n_month", F.sum("n").over(Window.partitionBy("month")))


from palisade.plans import code, extended, history  # noqa: E402, F401
