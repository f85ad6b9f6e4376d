"""Functions, statements, near-duplicates and drifts in source text written by hand, with blocks of any size."""

import random

import pytest

from palisade.operators import calibrate, duplicates
from palisade.sources import code

GO = '''package main

func Short() { return }

func (s *T) Long(
	a int,
	b string, // } comment
) error {
	x := "}{"
	for i := range b { // {
		if a > 3 { return nil }
	}
	return nil
}

type I interface {
	M() int
}
'''
PYTHON = '''import os

class A:
    def one(self,
            x):
        # comment
        return {
            "a": 1,
        }

    async def two(self):

        def inner():
            return 2
        return inner

def last(): return 1
def tail():
    return foo(
        1
    )
'''
SCRIPT = '''export class K {
  async get(a: string): Promise<X> {
    return a
  }
}
const f = (x) => {
  return x
}
function g() {
}
if (x) {
}
'''


def lines(spark, files):
    rows = [(p, n, t, "clash") for p, x in files.items() for n, t in enumerate(x.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, line_no int, text string, lang string")


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_functions(spark, monkeypatch, block):
    monkeypatch.setattr(code, "BLOCK", block)
    got = code.functions(lines(spark, {"a.go": GO, "b.py": PYTHON, "c.ts": SCRIPT, "d.txt": GO, "e.go": "func broken() {\n", "empty.py": ""})).collect()
    assert sorted((r["path"], r["name"], r["from_line"], r["to_line"], r["lang"]) for r in got) == [
        ("a.go", "Long", 5, 14, "go"), ("a.go", "Short", 3, 3, "go"),
        ("b.py", "inner", 13, 14, "python"), ("b.py", "last", 17, 17, "python"), ("b.py", "one", 4, 9, "python"), ("b.py", "tail", 18, 21, "python"), ("b.py", "two", 11, 15, "python"),
        ("c.ts", "f", 6, 8, "typescript"), ("c.ts", "g", 9, 10, "typescript"), ("c.ts", "get", 2, 4, "typescript"),
    ]


def test_statements_and_forms(spark):
    text = "import {\n  a,\n  b\n} from 'x'\nimport y from 'z'\nconst q = require('w')\nimport * as n from 'n'\nfoo()"
    got = calibrate.statement_forms(lines(spark, {"a.ts": text, "b.go": 'import (\n\t"a"\n)\nimport "b"\n', "c.py": "from a import (\n  b,\n)\nimport c\n"}), calibrate.IMPORTS).collect()
    assert sorted((r["path"], r["from_line"], r["to_line"], r["form"]) for r in got) == [
        ("a.ts", 1, 4, "named"), ("a.ts", 5, 5, "default"), ("a.ts", 6, 6, "require"), ("a.ts", 7, 7, "namespace"),
        ("b.go", 1, 3, "grouped"), ("b.go", 4, 4, "single"), ("c.py", 1, 3, "from"), ("c.py", 4, 4, "import"),
    ]
    errors = "func f() error {\n\treturn fmt.Errorf(\n\t\t\"no: %w\",\n\t\terr)\n}\nfunc g() error {\n\treturn nil, err\n}\nfunc h() {\n\tpanic(err)\n}\n"
    got = calibrate.statement_forms(lines(spark, {"a.go": errors}), calibrate.ERRORS).collect()
    assert sorted((r["from_line"], r["form"]) for r in got) == [(2, "wrap"), (7, "bare"), (10, "panic")]


def test_drift_judges_added_statements_only(spark):
    old = {f"o{n}.ts": "import { a } from 'x'\n" if n else "const a = require('x')\n" for n in range(6)}
    base = calibrate.form_counts(calibrate.statement_forms(lines(spark, old), calibrate.IMPORTS))
    new = calibrate.statement_forms(lines(spark, {"n.ts": "import { b } from 'y'\nconst c = require('z')\n", "n.py": "import os\n"}), calibrate.IMPORTS)
    assert [(r["path"], r["from_line"], r["form"], r["dominant"]) for r in calibrate.form_drift(new, base).collect()] == [("n.ts", 2, "require", "named")]
    mixed = spark.createDataFrame([("typescript", "named", 3), ("typescript", "require", 1)], "lang string, form string, n long")
    assert calibrate.form_drift(new, mixed, 0.8).count() == 0


def test_function_drift(spark):
    known = calibrate.conventions(spark.createDataFrame([("go", f"doIt{n}", 1, 4) for n in range(9)] + [("go", "do_it", 1, 4), ("python", "aB", 1, 2), ("python", "a_b", 1, 2), ("js", "one", 1, 2)], "lang string, name string, from_line long, to_line long"))
    added = spark.createDataFrame([("go", "do_that", 1, 4), ("go", "run", 1, 4), ("go", "doThat", 1, 9), ("python", "c_d", 1, 2), ("rust", "x_y", 1, 2), ("js", "a_b", 1, 2)], "lang string, name string, from_line long, to_line long")
    got = {r["name"]: (r["name_drifts"], r["size_drifts"]) for r in calibrate.function_drift(added, known, 0.8, 2.0).collect()}
    assert got == {"do_that": (True, False), "doThat": (False, True)}


def test_renamed_copy_is_a_duplicate(spark):
    copy = GO.replace("Long", "Other").replace("range b", "range names").replace("a > 3", "limit > 77").replace('"}{"', '"other"').replace("func Short() { return }\n", "")
    old, new = lines(spark, {"old.go": GO, "same.py": PYTHON}), lines(spark, {"new.go": copy, "new.ts": SCRIPT})
    streams = lambda x: duplicates.streams(x, code.functions(x))
    got = duplicates.near_duplicates(streams(new), streams(old)).collect()
    assert [(r["path"], r["name"], r["similarity"], r["match_path"], r["match_name"], r["match_line"]) for r in got] == [("new.go", "Other", 1.0, "old.go", "Long", 5)]
    told = duplicates.finding_rows(duplicates.near_duplicates(streams(new), streams(old))).first()
    assert told["suggestion"] == "see Long at old.go:5" and told["severity"] == "warn" and "100%" in told["message"]


@pytest.mark.parametrize("percent", [60, 85])
def test_near_duplicates_brute_force(spark, percent):
    random.seed(7)
    def stream():
        return [random.choice("abcdef") for _ in range(random.choice([2, 5, 12, 40]))]
    base = [stream() for _ in range(12)]
    rows = []
    for n in range(90):
        t = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2])):
            t[random.randrange(len(t))] = random.choice("abcxyz")
        rows.append((random.choice(["go", "python"]), f"f{n % 30}", f"n{n % 7}", n, t))
    schema = "lang string, path string, name string, from_line int, tokens array<string>"
    new, old = rows[:40], rows[20:]
    got = {(r["path"], r["name"], r["from_line"]): (round(r["similarity"], 9), r["match_path"], r["match_line"], r["match_name"]) for r in duplicates.near_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), 3, percent).collect()}
    runs = lambda t: {" ".join(t[i : i + 3]) for i in range(max(len(t) - 3, 0) + 1)}
    want = {}
    for lang, path, name, at, t in new:
        best = []
        for lang2, path2, name2, at2, u in old:
            a, b = runs(t), runs(u)
            if lang == lang2 and (path, name, at) != (path2, name2, at2) and len(a & b) * 100 >= percent * len(a | b):
                best.append((-round(len(a & b) / len(a | b), 9), path2, at2, name2))
        if best:
            s, *where = min(best)
            want[path, name, at] = (-s, *where)
    assert got == want
    assert duplicates.near_duplicates(spark.createDataFrame([], schema), spark.createDataFrame(old, schema)).count() == 0


def test_functions_of_one_set_are_one_class(spark, monkeypatch):
    random.seed(3)
    rows = [("go", f"f{n}", "x", n, ["a"] * 5 + random.choices("bc", k=30) + ["d"] * 5) for n in range(200)]
    # Whatever their order and number, they have the runs of two tokens that one of them has.
    rows += [("go", f"g{n}", "y", n, list("pq" * (3 + n))) for n in range(200)]
    schema = "lang string, path string, name string, from_line int, tokens array<string>"
    tables = {}
    keep = duplicates.settled
    monkeypatch.setattr(duplicates, "settled", lambda df, label: tables.setdefault(label, keep(df, label)))
    both = spark.createDataFrame(rows, schema)
    got = {(r["path"], r["from_line"]): (r["similarity"], r["match_path"]) for r in duplicates.near_duplicates(both, both, 2, 85).collect()}
    assert tables["classes"].count() < 20
    assert len(got) == 400 and got["g0", 0] == (1.0, "g1") and got["g7", 7] == (1.0, "g0")


def test_repeated_rows_of_an_inventory_hide_no_match(spark):
    own, other = ("go", "a.go", "f", 1, list("abcdefgh")), ("go", "b.go", "g", 5, list("abcdefgh"))
    schema = "lang string, path string, name string, from_line int, tokens array<string>"
    got = duplicates.near_duplicates(spark.createDataFrame([own], schema), spark.createDataFrame([own, own, own, other], schema)).collect()
    assert [(r["match_path"], r["match_line"], r["similarity"]) for r in got] == [("b.go", 5, 1.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_functions_go_through_no_driver(spark):
    rows = spark.createDataFrame([("a.py", "python", n, f"f{n}" if n % 3 == 0 else None, 0, n % 3, n) for n in range(60)], "path string, lang string, line_no long, name string, up long, _in int, _at long")
    # Only what blocks hand on, which for most files is nothing, may be sent around.
    assert plan(code.indented(rows)).count("BroadcastHashJoin") <= 1
    assert code.indented(rows).count() == 20


def test_of_drift_only_what_is_known_is_sent_around(spark):
    added = spark.createDataFrame([("go", "doThat", 1, 9), ("py", "run", 1, 9)], "lang string, name string, from_line long, to_line long")
    known = calibrate.conventions(spark.range(100_000).selectExpr("if(id % 2 = 0, 'go', 'py') AS lang", "concat('do_it', id) AS name", "1L AS from_line", "4L AS to_line"))
    joins = [x for x in plan(calibrate.function_drift(added, known)).split("\n") if "Join" in x]
    assert "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]


def test_drift_looks_through_files_once(spark, monkeypatch):
    from palisade.plans import code as queries

    seen = []
    keep = code.functions
    monkeypatch.setattr(code, "functions", lambda lines: seen.append(1) or keep(lines))
    queries.code_function_drift(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1
