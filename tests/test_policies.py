"""Policy files as tables, and gates' smaller parts: path prefixes, stale reports, one-shot tokens over days."""

import datetime
import json
import random

from pyspark.sql import functions as F

from palisade.functions.globs import prefixes, split_glob, to_regex
from palisade.operators import calibrate, engine, gates
from palisade.operators.policy import Policy
from palisade.sources import policies


def test_policy_files(spark):
    files = {
        "plain": {"mode": "warn", "gates": {"diff_budget": {"max_lines": 50}, "scope": {"allow_always": ["a/**"]}}, "rule_overrides": {"ai_patterns/no-broad-catch": "error"}},
        "unknown": {"zeta": 1, "gates": {"diff_budget": {"max_line": 50}, "scope": {}}, "provenance": {"a": {"b": {"c": 1}}}},
        "bad": {"mode": "strict", "gates": {"diff_budget": {"max_lines": -1, "max_files": "x"}}, "rule_overrides": {"a/b": "fatal"}, "provenance": {"apply_gates_to": "some"}},
        "empty": {},
    }
    rows = [(k, json.dumps(v), "clash") for k, v in files.items()] + [("blank", " ", ""), ("null", None, ""), ("list", "[1]", ""), ("broken", "{", "")]
    frame = spark.createDataFrame(rows, "repo string, text string, key string")
    repos = spark.createDataFrame([(r[0],) for r in rows] + [("none",)], "repo string")
    got = {r["repo"]: r for r in policies.overlaid(frame, repos).collect()}
    base = policies.defaults()
    for name in ("empty", "blank", "null", "none"):
        assert got[name]["settings"] == base and got[name]["errors"] == [] == got[name]["unknown"]
    assert got["plain"]["settings"] == base | {"mode": '"warn"', "gates.diff_budget.max_lines": "50", "gates.scope.allow_always": '["a/**"]', "rule_overrides.ai_patterns/no-broad-catch": '"error"'}
    assert got["unknown"]["settings"] is None and got["unknown"]["unknown"] == ["gates.diff_budget.max_line", "gates.scope", "provenance.a.b", "zeta"]
    assert got["bad"]["errors"] == ['gates.diff_budget.max_files: not of its kind: "x"', "gates.diff_budget.max_lines: negative: -1", 'mode: not a mode: "strict"', 'provenance.apply_gates_to: not a scope of gates: "some"', 'rule_overrides.a/b: not a severity: "fatal"']
    assert got["list"]["errors"] == ["not an object"] == got["broken"]["errors"] and got["list"]["settings"] is None
    assert json.loads(base["gates.branch_policy.protected"]) == ["main", "release/*"] and policies.overlaid(frame.limit(0), repos.limit(0)).count() == 0


GLOBS = ["a/b.go", "a/**", "a/b/**", "**", "**/*.go", "a/*/c.go", "*.go", "a/{b,c}/d.go", "a\\*/b", "/a/**", "/**", "", "a//b", "a/b/", "x/[ab].go", "a/**/z.go", "ä/**"]
PATHS = ["a/b.go", "a", "a/b/c.go", "b.go", "a/x/c.go", "a/b/d.go", "a*/b", "/a/c", "/a", "", "a//b", "a/b/", "x/a.go", "a/z.go", "a/q/r/z.go", "ä/ö", "a\n/b.go", "ab/c"]


def test_prefixes_lose_no_match(spark):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    own = {r["path"]: set(r["x"]) for r in paths.select("path", prefixes(F.col("path")).alias("x")).collect()}
    hits = {r["path"]: r for r in paths.select("path", *[F.col("path").rlike(to_regex(g)).alias(f"g{i}") for i, g in enumerate(GLOBS)]).collect()}
    for i, g in enumerate(GLOBS):
        prefix, kind = split_glob(g)
        for p in PATHS:
            met = prefix in own[p] and (kind == "below" or (kind == "exact" and prefix == p) or (kind == "regex" and hits[p][f"g{i}"]))
            assert met == hits[p][f"g{i}"], (g, p)


def test_scope_by_many_manifests(spark):
    random.seed(2)
    manifests = {c: random.sample(GLOBS, random.randint(1, 5)) for c in range(12)}
    files = [(c, p) for c in range(14) for p in PATHS]
    got = gates.scope(spark.createDataFrame(files, "change_id long, path string"), Policy(), spark.createDataFrame(list(manifests.items()), "change_id long, paths array<string>")).collect()
    hits = {r["p"]: r for r in spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", *[F.col("p").rlike(to_regex(g)).alias(str(i)) for i, g in enumerate(GLOBS)]).collect()}
    assert {(r["change_id"], r["file"]) for r in got} == {(c, p) for c, p in files if c in manifests and not any(hits[p][str(GLOBS.index(g))] for g in manifests[c])}


def test_latest_report_of_each_path(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    judged = spark.createDataFrame([(1, "a", at(10), at(60)), (1, "b", at(10), at(60)), (2, "a", at(200), at(201)), (3, "c", at(5), at(6)), (4, "a", at(10), at(11)), (5, None, at(1), at(2))], "change_id long, path string, changed_at timestamp, judged_at timestamp")
    made = spark.createDataFrame([("a", at(50)), ("a", at(12)), ("b", at(60)), ("b", at(61)), ("c", at(7)), (None, at(2))], "path string, made_at timestamp")
    assert {r["change_id"]: r["stale"] for r in calibrate.artifact_states(judged, made).collect()} == {1: False, 2: True, 5: False}


def test_one_shot_tokens(spark):
    random.seed(8)
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    changes = [(n, random.choice(["main", "main", "dev", None]), random.randrange(200)) for n in range(80)]
    tokens = [(random.choice(["main", "dev", "idle", None]), random.randrange(200)) for _ in range(30)]
    want = set()
    for branch in {b for _, b, _ in changes}:
        armed = False
        for _, c, n in sorted([(h, 1, n) for n, b, h in changes if b == branch] + [(h, 0, -1) for b, h in tokens if b == branch]):
            if not c:
                armed = True
            elif armed:
                want.add(n)
                armed = False
    rows = spark.createDataFrame([(n, b, at(h)) for n, b, h in changes], "change_id long, branch string, committed_at timestamp")
    log = spark.createDataFrame([(b, at(h)) for b, h in tokens], "branch string, ts timestamp")
    got = {r["change_id"] for r in engine.bypassed(rows, log, "enforce").collect()}
    assert got == {n for n in want if changes[n][1] is not None}
    assert engine.bypassed(rows, log, "ci_strict").count() == 0


def test_gates_of_ones_own(spark):
    """A rule with a suggestion and a fix, and a gate that the library doesn't have, through the engine into a report."""
    from palisade.operators import reports
    from palisade.operators.policy import RULES, Rule

    rule = Rule("no-todo", r"TODO", "warn", "left to do", "Do it.", ("TODO",), ("done",), suggestion="do it now", fix="delete the line")

    def mine(tables, policy):
        big = tables.files.where("added > 5")
        return big.select("change_id", F.lit(9).alias("gate_ord"), F.lit("mine").alias("gate"), F.lit("big").alias("rule_id"), F.lit("info").alias("severity"), F.col("path").alias("file"), F.lit(None).cast("long").alias("line"),
                          F.lit("big").alias("message"), F.lit("").alias("retry_hint"), F.lit(0).alias("rule_ord"))

    changes = spark.createDataFrame([(1, None, "feature/x", "", "", False, "t")], "change_id long, committed_at timestamp, branch string, message string, env_agent string, is_merge boolean, tree_hash string")
    files = spark.createDataFrame([(1, "a.py", "modified", 9, 0)], "change_id long, path string, kind string, added long, removed long")
    lines = spark.createDataFrame([(1, "a.py", 3, "# TODO"), (1, "a.py", 4, "except:")], "change_id long, path string, line_no int, text string")
    found = engine.evaluate(engine.Tables(changes, files, lines), Policy(), (lambda t, p: gates.ai_patterns(t.lines, p, (*RULES, rule)), mine))
    assert sorted((r["gate"], r["rule_id"], r["suggestion"], r["fix"]) for r in found.collect()) == [("ai_patterns", "no-broad-catch", None, None), ("ai_patterns", "no-todo", "do it now", "delete the line"), ("mine", "big", None, None)]
    report = json.loads(reports.json_reports(engine.verdicts(changes, found, "enforce"), found).first()["report"])
    assert [sorted(x) for x in report["findings"]] == [sorted(["docs_url", "file", "fix", "gate", "line", "message", "retry_hint", "rule_id", "severity", "suggestion"]), ["docs_url", "file", "gate", "line", "message", "retry_hint", "rule_id", "severity"], ["docs_url", "file", "gate", "message", "retry_hint", "rule_id", "severity"]]


def test_quoted(spark):
    texts = ['a"b\\c', "\t\n\r", "\x00\x07\x08\x0b\x0c\x1f\x7fé", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", gates.go_quoted(F.col("t")).alias("q")).orderBy("n").collect()
    assert [r["q"] for r in rows] == ['"a\\"b\\\\c"', '"\\t\\n\\r"', '"\\x00\\a\\b\\v\\f\\x1f\\x7fé"', '""']
