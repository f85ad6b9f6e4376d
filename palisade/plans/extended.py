"""More registered queries: listings, reports, records, explanations and calibration, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import calibrate, engine, explain, gates, records, reports
from palisade.plans.registry import ALL, DETECT, HITS, LET_OFF, POLICY, findings, query
from palisade.sources import adapters as A
from palisade.sources import commits, patches

PLACE = "gate_ord, coalesce(file, ''), coalesce(line, 0), rule_ord"
LINKED = f"linked AS (SELECT *, '{engine.DOCS}' || replace(gate, '_', '-') || '-' || replace(rule_id, '/', '-') || '.md' AS docs_url FROM found)"
COUNTED = """counts AS (SELECT c.change_id, count(f.change_id) AS n_findings, count(*) FILTER (f.severity = 'error') AS n_errors, count(*) FILTER (f.severity = 'warn') AS n_warnings,
    count(*) FILTER (f.severity = 'info') AS n_info FROM changes c LEFT JOIN found f ON c.change_id = f.change_id GROUP BY 1)"""
SAFE = "replace(replace(replace({}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"


# Listings of a change's files


@query("name_status_decode", f"WITH {A.FILES_SQL} SELECT change_id, path, CASE kind WHEN 'renamed' THEN 'old/' || path END AS old_path, kind FROM files")
def name_status_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as NUL-delimited listings, one a change, then read back."""
    letter = F.when(F.col("kind") == "added", "A").when(F.col("kind") == "deleted", "D").when(F.col("kind") == "renamed", F.concat(F.lit("R100\x00old/"), "path")).otherwise("M")
    rows = A.files(spark, sf_dir).select("change_id", F.concat(letter, F.lit("\x00"), "path", F.lit("\x00")).alias("t"))
    return patches.name_status(rows.groupBy("change_id").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("text")), "change_id")


@query("patch_files", f"""WITH {A.FILES_SQL} SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY path) AS INTEGER) AS file_ord, path, CASE kind WHEN 'renamed' THEN 'old/' || path END AS old_path, kind,
    CASE WHEN kind = 'added' THEN 2 WHEN kind = 'deleted' OR (kind = 'modified' AND added % 2 = 0) THEN 0 ELSE 1 END AS added, CASE WHEN kind = 'added' OR (kind = 'modified' AND added % 2 = 0) THEN 0 ELSE 1 END AS removed,
    kind = 'modified' AND added % 2 = 0 AS is_binary FROM files""")  # fmt: skip
def patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as patches, one a change, with texts that look like headers, then read back."""
    p = F.col("path")
    part = (
        F.when(F.col("kind") == "added", F.concat(F.lit("--- /dev/null\n+++ b/"), p, F.lit("\n@@ -0,0 +1,2 @@\n+one\n+++ two\n")))
        .when(F.col("kind") == "deleted", F.concat(F.lit("--- a/"), p, F.lit("\n+++ /dev/null\n@@ -1 +0,0 @@\n--- gone\n")))
        .when(F.col("kind") == "renamed", F.concat(F.lit("--- a/old/"), p, F.lit("\n+++ b/"), p, F.lit("\t\n@@ -3 +3 @@\n-x\n+y\n")))
        .when(F.col("added") % 2 == 0, F.concat(F.lit("Binary files a/"), p, F.lit(" and b/"), p, F.lit(" differ\n")))
        .otherwise(F.concat(F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n@@ -1,2 +1,2 @@\n ctx\n-a\n+b\n")))
    )
    whole = A.files(spark, sf_dir).groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct("path", part.alias("t")))).alias("x"))
    return patches.patch_files(whole.select("change_id", F.array_join(F.transform("x", lambda y: y["t"]), "").alias("text")), "change_id")


@query("long_patch_lines", f"WITH {A.LINES_SQL} SELECT d.source, a.path, '+' AS op, a.line_no, a.text FROM added_lines a JOIN documents d ON d.doc_id = a.change_id")
def long_patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each source, which adds all its documents, given line by line; the largest is a third of all lines."""
    docs = A.read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("change_id"))
    lines = A.added_lines(spark, sf_dir)
    place = lambda p: (F.col("change_id") * (1 << 20) + p).alias("pos")
    body = lines.select("change_id", place(F.col("line_no") + 2), F.concat(F.lit("+"), "text").alias("raw"))
    sizes = lines.groupBy("change_id", "path").agg(F.count("*").cast("string").alias("n"))
    heads = F.array(F.lit("--- /dev/null"), F.concat(F.lit("+++ b/"), "path"), F.concat(F.lit("@@ -0,0 +1,"), "n", F.lit(" @@")))
    head = sizes.select("change_id", F.posexplode(heads).alias("p", "raw")).select("change_id", place(F.col("p")), "raw")
    return patches.patch_lines(body.unionByName(head).join(docs, "change_id").select("source", "pos", "raw"), "source", block=1 << 28)


@query("diff_assembly", f"""WITH {A.LINES_SQL}, n AS (SELECT change_id, path, count(*) AS added FROM added_lines GROUP BY 1, 2) SELECT change_id, path, CASE WHEN change_id % 3 <> 2 AND change_id % 4 = 3 THEN 'old/' || path END AS old_path,
    CASE WHEN change_id % 3 = 2 THEN 'modified' ELSE list_extract(['added', 'modified', 'deleted', 'renamed'], CAST(change_id % 4 + 1 AS INTEGER)) END AS kind, added, change_id % 5 AS removed, FALSE AS is_binary,
    CASE WHEN change_id % 2 = 0 THEN added ELSE 0 END AS n_lines FROM n""")  # fmt: skip
def diff_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three listings of the same files: counts of all, kinds of two thirds, content of half; put together by path."""
    lines = A.added_lines(spark, sf_dir)
    files = lines.groupBy("change_id", "path").agg(F.count("*").alias("n"))
    counts = patches.numstat(files.select("change_id", F.concat(F.col("n").cast("string"), F.lit("\t"), (F.col("change_id") % 5).cast("string"), F.lit("\t"), "path", F.lit("\x00")).alias("text")), "change_id")
    letter = F.element_at(F.array(F.lit("A"), F.lit("M"), F.lit("D"), F.concat(F.lit("R090\x00old/"), "path")), (F.col("change_id") % 4 + 1).cast("int"))
    kinds = patches.name_status(files.where("change_id % 3 <> 2").select("change_id", F.concat(letter, F.lit("\x00"), "path", F.lit("\x00")).alias("text")), "change_id")
    out = patches.assembled(counts, kinds, lines.where("change_id % 2 = 0"), "change_id")
    return out.withColumn("n_lines", F.size("lines").cast("long")).drop("lines")


@query("diff_totals", f"WITH {A.FILES_SQL} SELECT change_id, CAST(sum(added + removed) AS BIGINT) AS changed_lines, count(*) FILTER (kind = 'added') AS new_files FROM files GROUP BY 1")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.files(spark, sf_dir).groupBy("change_id").agg(F.sum(F.col("added") + F.col("removed")).alias("changed_lines"), F.count_if(F.col("kind") == "added").alias("new_files"))


# Commits


@query("commit_order", f"WITH {A.CHANGES_SQL} SELECT change_id, committed_at FROM changes WHERE NOT is_merge")
def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.in_order(A.changes(spark, sf_dir)).select("change_id", "committed_at")


@query("range_commits", f"WITH {A.CHANGES_SQL}, r AS (SELECT DISTINCT change_id // 1000 AS range_id FROM changes) SELECT range_id, change_id, branch FROM changes JOIN r ON change_id > 1000 * range_id + 500 AND change_id <= 1000 * range_id + 1700")
def range_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = A.changes(spark, sf_dir)
    ranges = changes.select(F.expr("change_id div 1000").alias("range_id")).distinct().selectExpr("range_id", "1000 * range_id + 500 AS base", "1000 * range_id + 1700 AS head")
    return commits.in_ranges(changes, ranges, 400).select("range_id", "change_id", "branch")


@query("message_attribution", f"{ALL} SELECT change_id, gate, rule_id, message || ' (commit ' || substr(md5(CAST(change_id AS VARCHAR)), 1, 7) || ')' AS message FROM found WHERE change_id IN (SELECT change_id FROM changes)")
def message_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.attributed(findings(spark, sf_dir), A.changes(spark, sf_dir)).select("change_id", "gate", "rule_id", "message")


@query("unpushed_commits", f"WITH {A.CHANGES_SQL} SELECT change_id, branch FROM changes WHERE change_id % 4 = 0")
def unpushed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = A.changes(spark, sf_dir)
    return commits.unpushed(changes, changes.where("change_id % 4 <> 0")).select("change_id", "branch")


@query("ci_ranges", """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 'v' || CAST(o_custkey AS VARCHAR) || '..HEAD' WHEN o_orderkey % 5 = 0 THEN md5(CAST(o_custkey AS VARCHAR)) || '..' || md5(CAST(o_orderkey AS VARCHAR))
    WHEN o_orderkey % 3 <> 0 THEN md5(CAST(o_orderkey - 1 AS VARCHAR)) || '..' || md5(CAST(o_orderkey AS VARCHAR)) ELSE 'HEAD~1..HEAD' END AS range FROM orders""")  # fmt: skip
def ci_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id", "CASE WHEN o_orderkey % 7 = 0 THEN concat('v', cast(o_custkey AS string), '..HEAD') ELSE '' END AS given",
        "CASE WHEN o_orderkey % 5 = 0 THEN md5(cast(o_custkey AS string)) END AS base", "CASE WHEN o_orderkey % 5 = 0 THEN md5(cast(o_orderkey AS string)) END AS head",
        f"CASE WHEN o_orderkey % 3 = 0 THEN '{commits.NO_COMMIT}' ELSE md5(cast(o_orderkey - 1 AS string)) END AS before", "md5(cast(o_orderkey AS string)) AS after",
    )
    return commits.ci_ranges(runs)


# Manifests and overrides


TASKS = ("CASE WHEN o_orderkey % 6 = 0 THEN concat('task-', cast(o_orderkey AS string)) ELSE ' ' END", "CASE WHEN o_orderkey % 4 = 0 THEN 'task.yml' END", "CASE WHEN o_orderkey % 3 = 0 THEN concat('JIRA-', cast(o_custkey AS string)) END")


@query("manifest_precedence", """SELECT o_orderkey AS change_id, CASE WHEN o_orderkey % 6 = 0 THEN 'task-' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 4 = 0 THEN 'task.yml' WHEN o_orderkey % 3 = 0 THEN 'JIRA-' || CAST(o_custkey AS VARCHAR) END AS manifest,
    CASE WHEN o_orderkey % 6 = 0 THEN 'flag' WHEN o_orderkey % 4 = 0 THEN 'file' WHEN o_orderkey % 3 = 0 THEN 'ticket' ELSE 'none' END AS manifest_source FROM orders""")  # fmt: skip
def manifest_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.manifest_of(A.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS change_id", f"{TASKS[0]} AS flag", f"{TASKS[1]} AS file", f"{TASKS[2]} AS ticket"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of every third change; every 41st of these holds a pattern that is none."""
    paths = F.array(F.lit("standard/**"), F.when(F.col("change_id") % 41 == 0, "lib/[a").otherwise("economy/**"))
    return A.changes(spark, sf_dir).where("change_id % 3 = 0").select("change_id", F.concat(F.lit('task "'), F.col("change_id").cast("string"), F.lit('"')).alias("id"), paths.alias("paths"))


@query("manifest_states", f"""WITH {A.CHANGES_SQL} SELECT change_id, CASE WHEN change_id % 3 = 0 THEN 'task "' || CAST(change_id AS VARCHAR) || '"' END AS id, change_id % 3 = 0 AS found,
    CASE WHEN change_id % 123 = 0 THEN 'bad pattern in the manifest: lib/[a' END AS error FROM changes""")  # fmt: skip
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = manifests(spark, sf_dir)
    return commits.manifest_states(A.changes(spark, sf_dir), own, gates.manifest_errors(own))


@query("manifest_texts", f"""WITH {A.CHANGES_SQL} SELECT change_id, 'id: "task \\"' || CAST(change_id AS VARCHAR) || '\\""' || chr(10) || 'paths:' || chr(10) || '  - "standard/**"' || chr(10) || '  - "' ||
    CASE WHEN change_id % 41 = 0 THEN 'lib/[a' ELSE 'economy/**' END || '"' || chr(10) AS text FROM changes WHERE change_id % 3 = 0""")  # fmt: skip
def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.manifest_texts(manifests(spark, sf_dir))


@query("gate_error_verdicts", f"""{ALL}, {COUNTED}, e AS (SELECT *, CASE WHEN change_id % 123 = 0 THEN 1 ELSE 0 END AS bad FROM counts)
    SELECT change_id, n_findings, n_errors, n_warnings, n_info, CAST(bad AS BIGINT) AS n_gate_errors, n_errors > 0 OR bad > 0 AS blocking, CASE WHEN n_errors > 0 OR bad > 0 THEN 'blocked' ELSE 'passed' END AS result,
    CASE WHEN change_id % 97 = 0 THEN 2 WHEN n_errors > 0 OR bad > 0 THEN 1 ELSE 0 END AS exit_code FROM e""")  # fmt: skip
def gate_error_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with a bad manifest fail in a gate; every 97th could not be looked at."""
    changes = A.changes(spark, sf_dir)
    return engine.verdicts(changes, findings(spark, sf_dir), POLICY.mode, gates.manifest_errors(manifests(spark, sf_dir)), changes.where("change_id % 97 = 0"))


@query("override_rules", f"WITH {A.CHANGES_SQL}, {LET_OFF} SELECT change_id, rule_id, 'override' AS off_by FROM overridden WHERE rule_id IN ('no-broad-catch', 'no-new-lint-suppressions')")
def override_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.merged_overrides(POLICY, engine.override_ids(A.changes(spark, sf_dir), POLICY.mode), gates.rule_table(spark, POLICY))


@query("overridden_findings", f"WITH {A.CHANGES_SQL}, {A.LINES_SQL}, {LET_OFF} SELECT change_id, path AS file, line_no AS line, rule_id FROM ({HITS}) h WHERE NOT EXISTS (SELECT 1 FROM overridden o WHERE o.change_id = h.change_id AND o.rule_id = h.rule_id)")
def overridden_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = engine.override_ids(A.changes(spark, sf_dir), POLICY.mode)
    return gates.ai_patterns(A.added_lines(spark, sf_dir), POLICY, overridden=off).select("change_id", "file", "line", "rule_id")


# Reports


@query("json_reports", f"""{ALL}, {LINKED}, {COUNTED}, f AS (SELECT change_id, string_agg('{{"gate":"' || gate || '","rule_id":"' || rule_id || '","severity":"' || severity || '"' || CASE WHEN file IS NULL THEN '' ELSE ',"file":' || CAST(to_json(file) AS VARCHAR) END
    || CASE WHEN line IS NULL THEN '' ELSE ',"line":' || CAST(line AS VARCHAR) END || ',"message":' || CAST(to_json(message) AS VARCHAR) || ',"docs_url":"' || docs_url || '","retry_hint":' || CAST(to_json(retry_hint) AS VARCHAR) || '}}', ',' ORDER BY {PLACE}) AS x
    FROM linked GROUP BY 1), firsts AS (SELECT change_id, retry_hint, min(struct_pack(a := gate_ord, b := coalesce(file, ''), c := coalesce(line, 0), d := rule_ord)) AS place FROM found GROUP BY 1, 2),
    h AS (SELECT change_id, string_agg(CAST(to_json(retry_hint) AS VARCHAR), ',' ORDER BY place, retry_hint) AS x FROM firsts GROUP BY 1)
    SELECT c.change_id, {SAFE.format("""'{"result":"' || CASE WHEN n_errors > 0 OR c.change_id % 123 = 0 THEN 'blocked' ELSE 'passed' END || '","findings":[' || coalesce(f.x, '') || '],"summary":{"findings":' || CAST(n_findings AS VARCHAR) || ',"errors":' || CAST(n_errors AS VARCHAR)
    || ',"warnings":' || CAST(n_warnings AS VARCHAR) || ',"info":' || CAST(n_info AS VARCHAR) || ',"gate_errors":' || CASE WHEN c.change_id % 123 = 0 THEN '1' ELSE '0' END || '},"retry_hints":[' || coalesce(h.x, '') || ']'
    || CASE WHEN c.change_id % 123 = 0 THEN ',"gate_errors":[{"gate":"scope","error":"bad pattern in the manifest: lib/[a"}]' ELSE '' END || '}'""")} AS report
    FROM counts c LEFT JOIN f ON f.change_id = c.change_id LEFT JOIN h ON h.change_id = c.change_id""")  # fmt: skip
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, errors = findings(spark, sf_dir), gates.manifest_errors(manifests(spark, sf_dir))
    return reports.json_reports(engine.verdicts(A.changes(spark, sf_dir), found, POLICY.mode, errors), found, errors)


@query("text_reports", f"""{ALL}, {COUNTED}, g AS (SELECT change_id, gate, gate || chr(10) || string_agg('  [' || severity || '] ' || message || CASE WHEN file IS NULL THEN '' ELSE ' ' || file || CASE WHEN line > 0 THEN ':' || CAST(line AS VARCHAR) ELSE '' END END, chr(10) ORDER BY {PLACE}) AS x FROM found GROUP BY 1, 2),
    b AS (SELECT change_id, string_agg(x, chr(10) || chr(10) ORDER BY gate) AS body FROM g GROUP BY 1) SELECT c.change_id, CASE WHEN body IS NULL THEN 'no findings' ELSE body || chr(10) || chr(10) ||
    CASE WHEN n_errors > 0 THEN 'blocked: ' || CAST(n_findings AS VARCHAR) || ' finding(s), ' || CAST(n_errors AS VARCHAR) || ' error(s)' ELSE CAST(n_findings AS VARCHAR) || ' advisory finding(s), not blocked' END END AS report
    FROM counts c LEFT JOIN b ON b.change_id = c.change_id""")  # fmt: skip
def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    return reports.text_reports(engine.verdicts(A.changes(spark, sf_dir), found, POLICY.mode), found)


@query("sarif_rules", f"""{ALL}, r AS (SELECT change_id, gate || '/' || rule_id AS rule, min(struct_pack(a := gate_ord, b := coalesce(file, ''), c := coalesce(line, 0), d := rule_ord)) AS place FROM found GROUP BY 1, 2)
    SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY place) - 1 AS INTEGER) AS rule_pos, rule FROM r""")  # fmt: skip
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_rules(findings(spark, sf_dir))


@query("sarif_documents", f"""{ALL}, r AS (SELECT change_id, gate, rule_id, min(struct_pack(a := gate_ord, b := coalesce(file, ''), c := coalesce(line, 0), d := rule_ord)) AS place FROM found GROUP BY 1, 2, 3),
    rules AS (SELECT change_id, string_agg('{{"id":"' || gate || '/' || rule_id || '","name":"' || rule_id || '"}}', ',' ORDER BY place) AS x FROM r GROUP BY 1),
    results AS (SELECT change_id, string_agg('{{"ruleId":"' || gate || '/' || rule_id || '","level":"' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END || '","message":{{"text":' || CAST(to_json(message) AS VARCHAR)
    || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || CAST(to_json(coalesce(file, '{reports.ANCHOR}')) AS VARCHAR) || '}}' || CASE WHEN file IS NOT NULL AND line > 0 THEN ',"region":{{"startLine":' || CAST(line AS VARCHAR) || '}}' ELSE '' END || '}}}}]}}', ',' ORDER BY {PLACE}) AS x FROM found GROUP BY 1)
    SELECT c.change_id, '{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"palisade","rules":[' || coalesce(rules.x, '') || ']}}}},"results":[' || coalesce(results.x, '') || ']}}]}}' AS sarif
    FROM changes c LEFT JOIN rules ON rules.change_id = c.change_id LEFT JOIN results ON results.change_id = c.change_id""")  # fmt: skip
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_documents(A.changes(spark, sf_dir), findings(spark, sf_dir))


# Explanations


@query("explain_rules", f"""WITH asked AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'ai_patterns/' ELSE '' END || CASE event_id % 5 WHEN 0 THEN 'no-broad-catch' WHEN 1 THEN 'max-lines' WHEN 2 THEN 'no-hardcoded-secrets' WHEN 3 THEN 'scope/out-of-scope' ELSE event_type END AS rule FROM events),
    e AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{r}', '{s.replace(chr(39), chr(39) * 2)}', '{state}')" for g, r, s, state in explain.ENTRIES)}) t(gate, rule_id, summary, state)), k AS (SELECT rule, regexp_replace(rule, '^(branch_policy|diff_budget|ai_patterns|scope|diff_coverage)/', '') AS rule_id FROM asked)
    SELECT k.rule, k.rule_id, summary, '{engine.DOCS}' || replace(gate, '_', '-') || '-' || k.rule_id || '.md' AS docs_url, coalesce(state, 'unknown') AS state, CASE WHEN summary IS NULL THEN 2 ELSE 0 END AS exit_code FROM k LEFT JOIN e ON e.rule_id = k.rule_id""")  # fmt: skip
def explain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("event_id") % 5 == 0, "no-broad-catch").when(F.col("event_id") % 5 == 1, "max-lines").when(F.col("event_id") % 5 == 2, "no-hardcoded-secrets").when(F.col("event_id") % 5 == 3, "scope/out-of-scope").otherwise(F.col("event_type"))
    asked = A.read(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, "ai_patterns/").otherwise(""), named).alias("rule")).distinct()
    return explain.explained(asked, explain.entries(spark))


@query("rule_pass_count", f"WITH {A.LINES_SQL}, hits AS ({HITS}), n AS (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) SELECT count(*) FILTER (n >= 0) AS n_ok, count(*) AS n_rules, 0 AS exit_code FROM n")
def rule_pass_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rules that found something in the added lines, how many agree with their own examples."""
    hits = gates.ai_patterns(A.added_lines(spark, sf_dir), POLICY).select("rule_id").distinct()
    return explain.pass_count(gates.rule_table(spark, POLICY).join(hits, "rule_id", "left_semi"))


# Records


STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


@query("bypass_records", f"""WITH {A.CHANGES_SQL} SELECT change_id, '{{"timestamp":"' || {STAMP.format("committed_at")} || '","reason":"hotfix ' || CAST(change_id AS VARCHAR) || '","branch":"' || branch || '","tree_hash":"' || tree_hash || '"}}' AS record,
    'hotfix ' || CAST(change_id AS VARCHAR) || chr(10) AS token, 'bypass: hotfix ' || CAST(change_id AS VARCHAR) AS note FROM changes WHERE change_id % 29 = 0 AND change_id % 2 = 0""")  # fmt: skip
def bypass_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = A.changes(spark, sf_dir).where("change_id % 29 = 0").withColumns({"at": F.col("committed_at"), "reason": F.when(F.col("change_id") % 2 == 0, F.concat(F.lit("hotfix "), F.col("change_id").cast("string"))).otherwise(" ")})
    return records.bypasses(asked, POLICY.mode)


@query("provenance_notes", f"""{ALL}, {COUNTED} SELECT change_id, '{{' || CASE prov_source WHEN 'env' THEN '"agent":"Devin",' WHEN 'trailer' THEN '"agent":"Cursor",' ELSE '' END || '"source":"' || prov_source || '"}}' AS note
    FROM detected WHERE prov_source <> 'none' AND change_id IN (SELECT change_id FROM counts WHERE n_errors = 0)""")  # fmt: skip
def provenance_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = A.changes(spark, sf_dir)
    return records.provenance_notes(gates.detect(changes, POLICY), engine.verdicts(changes, findings(spark, sf_dir), POLICY.mode))


@query("feedback_urls", f"""SELECT event_id AS report_id, '{{"timestamp":"' || {STAMP.format("ts")} || '","rule_id":"ai_patterns/' || event_type || '","reason":"not so: ' || CAST(user_id AS VARCHAR) || '"}}' AS record,
    'https://issues.example.org/new?body=' || replace(url_encode('Rule: ai_patterns/' || event_type || chr(10) || chr(10) || 'not so: ' || CAST(user_id AS VARCHAR)), '%20', '+') || '&title=' || replace(url_encode('[false-positive] ai_patterns/' || event_type), '%20', '+') AS url FROM events""")  # fmt: skip
def feedback_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat(F.lit("not so: "), F.col("user_id").cast("string"))
    told = A.read(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.col("ts").alias("at"), F.concat(F.lit("ai_patterns/"), "event_type").alias("rule_id"), reason.alias("reason"))
    return records.feedback(told, "https://issues.example.org/new")


@query("marker_append", f"WITH {A.CHANGES_SQL} SELECT DISTINCT tree_hash FROM changes WHERE change_id % 3 <> 0 OR change_id % 5 = 0")
def marker_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.marked(A.markers(spark, sf_dir), A.changes(spark, sf_dir).where("change_id % 5 = 0"))


# Calibration


FUNCTIONS = {"lang": "lower(substr(p_type, 1, strpos(p_type, ' ') - 1))", "name": "CASE WHEN p_partkey % 11 = 0 THEN replace(p_name, ' ', '-') WHEN p_partkey % 13 = 0 THEN substr(p_name, 1, 4) ELSE replace(p_name, ' ', '_') END", "size": "p_size"}
FUNCTIONS_SQL = f"functions AS (SELECT p_partkey AS id, {', '.join(f'{v} AS {k}' for k, v in FUNCTIONS.items())} FROM part)"
STYLE_SQL = """styled AS (SELECT *, CASE WHEN regexp_full_match(name, '[a-z][a-z0-9]*') THEN NULL WHEN regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)+') THEN 'snake' WHEN regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)+') THEN 'kebab'
    WHEN regexp_full_match(name, '[a-z][A-Za-z0-9]*') THEN 'camel' WHEN regexp_full_match(name, '[A-Z][A-Za-z0-9]*') THEN 'pascal' ELSE 'other' END AS style FROM functions)"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = {k: v.replace("strpos(p_type, ' ')", "instr(p_type, ' ')") for k, v in FUNCTIONS.items()}
    return A.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", *[f"{v} AS {k}" for k, v in sql.items()])


@query("language_fingerprint", f"""WITH {FUNCTIONS_SQL}, {STYLE_SQL}, s AS (SELECT lang, style, count(*) AS n FROM styled WHERE style IS NOT NULL GROUP BY 1, 2), t AS (SELECT lang, arg_max(style, struct_pack(a := n, b := style)) AS style FROM s GROUP BY 1),
    z AS (SELECT lang, count(*) AS n_functions, round(avg(size), 9) AS mean_size FROM functions GROUP BY 1) SELECT z.lang, n_functions, mean_size, style FROM z LEFT JOIN t ON t.lang = z.lang""")  # fmt: skip
def language_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.fingerprint(functions(spark, sf_dir)).withColumn("mean_size", F.round("mean_size", 9))


@query("naming_style_drift", f"""WITH {FUNCTIONS_SQL}, {STYLE_SQL}, k AS (SELECT * FROM styled WHERE style IS NOT NULL), c AS (SELECT lang, style, count(*) AS n FROM k GROUP BY 1, 2), t AS (SELECT lang, arg_max(style, struct_pack(a := n, b := style)) AS dominant, max(n) AS m, sum(n) AS total FROM c GROUP BY 1)
    SELECT k.id, k.lang, k.style, dominant FROM k JOIN t ON t.lang = k.lang WHERE m >= 0.8 * total AND k.style <> dominant""")  # fmt: skip
def naming_style_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = functions(spark, sf_dir).withColumn("style", calibrate.style(F.col("name")))
    return calibrate.drift(rows, "lang", "style", 0.8).select("id", "lang", "style", "dominant")


def forms_sql(form: str) -> str:
    return f"""WITH {A.LINES_SQL}, f AS (SELECT change_id, path, line_no, split_part(path, '/', 1) AS lang, {form} AS form FROM added_lines), k AS (SELECT * FROM f WHERE form IS NOT NULL), c AS (SELECT lang, form, count(*) AS n FROM k GROUP BY 1, 2),
        t AS (SELECT lang, arg_max(form, struct_pack(a := n, b := form)) AS dominant, max(n) AS m, sum(n) AS total FROM c GROUP BY 1) SELECT change_id, path, line_no, form, dominant FROM k JOIN t ON t.lang = k.lang WHERE m >= 0.8 * total AND form <> dominant"""


#: Lines stand for imports and for handled errors: every fifth line is one, its form follows from its place.
IMPORT_FORM = "CASE WHEN line_no % 5 <> 0 THEN NULL WHEN (change_id + line_no) % 9 = 0 THEN 'relative' ELSE 'absolute' END"
IDIOM_FORM = "CASE WHEN line_no % 5 <> 1 THEN NULL WHEN (change_id * 7 + line_no) % 20 = 0 THEN 'bare' WHEN (change_id * 7 + line_no) % 20 = 1 THEN 'panic' ELSE 'wrap' END"


def forms(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    rows = A.added_lines(spark, sf_dir).select("change_id", "path", "line_no", F.substring_index("path", "/", 1).alias("lang"), F.expr(form).alias("form"))
    return calibrate.drift(rows, "lang", "form", 0.8).select("change_id", "path", "line_no", "form", "dominant")


@query("import_style_drift", forms_sql(IMPORT_FORM))
def import_style_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(spark, sf_dir, IMPORT_FORM)


@query("error_idiom_drift", forms_sql(IDIOM_FORM))
def error_idiom_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(spark, sf_dir, IDIOM_FORM)


@query("census_net_new", f"WITH {A.LINES_SQL}, hits AS ({HITS}) SELECT DISTINCT rule_id, path AS file FROM hits WHERE (rule_id, path) NOT IN (SELECT (rule_id, path) FROM hits WHERE line_no % 4 <> 0)")
def census_net_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = gates.ai_patterns(A.added_lines(spark, sf_dir), POLICY)
    return calibrate.net_new(hits, hits.where("line % 4 <> 0"), "rule_id", "file")


@query("safe_demotions", f"WITH {A.LINES_SQL}, hits AS ({HITS}), a AS (SELECT rule_id, count(*) FILTER (line_no % 5 <> 0) * 10 < count(*) * 9 AS demote FROM hits GROUP BY 1) SELECT rule_id, 'warn' AS severity FROM a WHERE demote AND rule_id = 'no-new-lint-suppressions'")
def safe_demotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line counts as acted on; only rules whose severity is error can be demoted."""
    hits = gates.ai_patterns(A.added_lines(spark, sf_dir), POLICY).groupBy("rule_id").agg((F.count_if(F.col("line") % 5 != 0) * 10 < F.count("*") * 9).alias("demote"))
    return calibrate.demotions(hits, {"no-new-lint-suppressions": "error", "no-broad-catch": "warn"})


@query("architecture_rules", f"""WITH {A.LINES_SQL} SELECT change_id, path, line_no, 'no-direct-ing' AS rule_id FROM added_lines WHERE path LIKE 'en/%' AND regexp_matches(text, '\\bing\\w*') AND NOT regexp_full_match(path, 'en/src1[^/]*/.*')
    UNION ALL SELECT change_id, path, line_no, 'no-der' FROM added_lines WHERE path LIKE 'de/%' AND regexp_matches(text, '\\bder\\b')""")  # fmt: skip
def architecture_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"id": "no-direct-ing", "lang": "en", "pattern": r"\bing\w*", "allowed": ("en/src1*/**",)}, {"id": "no-der", "lang": "de", "pattern": r"\bder\b", "allowed": ()}]
    lines = A.added_lines(spark, sf_dir).withColumn("lang", F.substring_index("path", "/", 1))
    return calibrate.architecture(lines, rules, ("en", "de", "fr", "es"))


#: Shapes of keys.
SHAPES = {"access-key": r"AKIA[0-9A-Z]{12,}", "assignment": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{8,}", "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----"}


@query("secret_findings", f"""WITH {A.LINES_SQL} {" UNION ALL ".join(f"SELECT change_id, path, line_no, 'secret/{n}' AS rule_id, 'error' AS severity FROM added_lines WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for n, p in SHAPES.items())}
    UNION ALL SELECT change_id, path, line_no, 'secret/entropy', 'warn' FROM added_lines WHERE len(list_filter(regexp_extract_all(text, '["'']([A-Za-z0-9+/_=-]{{20,}})["'']', 1), lambda x: list_entropy(string_split(x, '')) >= 3.5)) > 0""")  # fmt: skip
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.secrets(A.added_lines(spark, sf_dir), SHAPES, 3.5)


@query("coverage_lcov", f"WITH {A.LINES_SQL} SELECT change_id, path, line_no, (change_id * 7 + line_no) % 10 < 7 AS hit FROM added_lines WHERE line_no % 2 = 1")
def coverage_lcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage written as lcov reports, one a change, then read back."""
    lines = A.added_lines(spark, sf_dir).where("line_no % 2 = 1")
    each = F.concat(F.lit("DA:"), F.col("line_no").cast("string"), F.lit(","), F.when((F.col("change_id") * 7 + F.col("line_no")) % 10 < 7, "3").otherwise("0"))
    whole = lines.groupBy("change_id", "path").agg(F.array_join(F.collect_list(each), "\n").alias("t"))
    return calibrate.lcov(whole.select("change_id", F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n"), "t", F.lit("\nend_of_record\n")).alias("text")), "change_id")


@query("coverage_go", f"WITH {A.LINES_SQL} SELECT change_id, path, line_no, max(hit) AS hit FROM (SELECT change_id, path, unnest([line_no, line_no + 1]) AS line_no, line_no % 6 = 0 AS hit FROM added_lines WHERE line_no % 3 = 0) GROUP BY 1, 2, 3")
def coverage_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two lines written as Go's profiles, one a change, then read back."""
    n = F.col("line_no")
    line = F.concat("path", F.lit(":"), n.cast("string"), F.lit(".1,"), (n + 1).cast("string"), F.lit(".9 1 "), F.when(n % 6 == 0, "2").otherwise("0"))
    whole = A.added_lines(spark, sf_dir).where("line_no % 3 = 0").groupBy("change_id").agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    return calibrate.go_cover(whole.select("change_id", F.concat(F.lit("mode: set\n"), "t", F.lit("\n")).alias("text")), "change_id")


@query("coverage_cobertura", f"WITH {A.LINES_SQL} SELECT change_id, path, line_no, line_no % 4 = 0 AS hit FROM added_lines WHERE line_no % 2 = 0")
def coverage_cobertura(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage written as Cobertura's XML, one report a change, then read back."""
    line = F.concat(F.lit('<line number="'), F.col("line_no").cast("string"), F.lit('" hits="'), F.when(F.col("line_no") % 4 == 0, "5").otherwise("0"), F.lit('"/>'))
    whole = A.added_lines(spark, sf_dir).where("line_no % 2 = 0").groupBy("change_id", "path").agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    return calibrate.cobertura(whole.select("change_id", F.concat(F.lit('<coverage><class name="c" filename="'), "path", F.lit('">\n<lines>'), "t", F.lit("</lines></class></coverage>")).alias("text")), "change_id")


@query("coverage_states", f"""WITH {A.LINES_SQL}, c AS (SELECT change_id, count(*) AS coverable, count(*) FILTER ((change_id * 7 + line_no) % 10 < 7) AS covered FROM added_lines WHERE line_no % 2 = 1 AND change_id % 7 <> 0 GROUP BY 1),
    d AS (SELECT DISTINCT change_id FROM added_lines), s AS (SELECT d.change_id, coalesce(coverable, 0) AS coverable, coalesce(covered, 0) AS covered, CASE WHEN d.change_id % 7 = 0 THEN 'missing' WHEN d.change_id % 5 = 0 THEN 'stale' WHEN covered * 100 < coverable * 70 THEN 'failed' ELSE 'passed' END AS state
    FROM d LEFT JOIN c ON c.change_id = d.change_id) SELECT change_id, coverable, covered, state = 'failed' AS failed, state FROM s""")  # fmt: skip
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.added_lines(spark, sf_dir)
    covered = lines.where("line_no % 2 = 1 and change_id % 7 <> 0").select("change_id", "path", "line_no", ((F.col("change_id") * 7 + F.col("line_no")) % 10 < 7).alias("hit"))
    artifacts = lines.select("change_id", (F.col("change_id") % 5 == 0).alias("stale")).where("change_id % 7 <> 0").distinct()
    return calibrate.coverage(lines, covered, 70, artifacts)


#: Reports of the first line's file, made every 40 days, or just before a change for every third; judged ten days after a change.
STALE_SQL = f"""{A.CHANGES_SQL}, judged AS (SELECT change_id, 'src/' || CAST(change_id % 50 AS VARCHAR) AS path, committed_at AS changed_at, committed_at + INTERVAL 10 DAY AS judged_at FROM changes),
    made AS (SELECT 'src/' || CAST(change_id % 50 AS VARCHAR) AS path, CASE WHEN change_id % 3 = 0 THEN committed_at - INTERVAL 1 DAY ELSE committed_at + INTERVAL 2 DAY END AS made_at FROM changes WHERE change_id % 50 < 45 AND change_id % 4 = 0)"""


@query("coverage_staleness", f"""WITH {STALE_SQL}, l AS (SELECT j.change_id, j.changed_at, max(m.made_at) AS made_at FROM judged j JOIN made m ON m.path = j.path AND m.made_at <= j.judged_at GROUP BY 1, 2)
    SELECT change_id, made_at < changed_at AS stale FROM l""")  # fmt: skip
def coverage_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the latest report of a change's file is older than the change."""
    rows = A.changes(spark, sf_dir)
    path, at = F.concat(F.lit("src/"), (F.col("change_id") % 50).cast("string")).alias("path"), F.col("committed_at")
    judged = rows.select("change_id", path, at.alias("changed_at"), (at + F.expr("interval 10 days")).alias("judged_at"))
    made = rows.where("change_id % 50 < 45 and change_id % 4 = 0").select(path, F.when(F.col("change_id") % 3 == 0, at - F.expr("interval 1 day")).otherwise(at + F.expr("interval 2 days")).alias("made_at"))
    return calibrate.artifact_states(judged, made)
