"""Patterns against another engine of the same syntax, and rules given as a table."""

import duckdb
import pytest

from palisade.functions.re2 import needles, to_java
from palisade.operators import rule_tables

PATTERNS = [
    r"a.b", r"(?s)a.b", r"[[:digit:]]+", r"[[:^digit:]]x", r"[a&&b]c", r"(?P<x>a)b", r"(?P<x_1>a)|c", r"x{,3}", r"x{2}", r"x{2,}y", r"x{1,2}?y", r"(?U)a+b", r"(?i)except", r"(?i:k)x", r"(?i)[k-m]\d", r"(?i)straSSe",
    r"^a", r"b$", r"(?m)^b", r"(?m)a$", r"\Ab", r"b\z", r"\bfoo\b", r"\Boo", r"\w+\s\W", r"[^\W\d]z", r"[\s\S]q", r"[]a]b", r"[^]a]b", r"[a-]c", r"[-a]c", r"[\]\\]d", r"\Qa.b\E", r"\Qa.b\E+c", r"\x41\x{42}", r"\101", r"\t\n", r"\pLx", r"\p{Lu}y",
    r"\P{L}z", r"\p{Greek}", r"[\p{Greek}1]2", r"(a|b)*c", r"(?:ab)+?c", r"a|", r"(|a)b", r"", r"()", r"a{b", r"{a}", r"a}b", r"x{0}y", r"é.", r"[é-ü]b", r"\.\*\+", r"#\s*noqa", r"catch\s*\{\s*\}", r"a(?i)b|c", r"(?i)a(?-i)b", r"((a)(b(c)))d", r"[[:word:][:space:]]!", r"[\d-x]!", r"(?i)[^k]1",
]
STRINGS = [
    "", "a", "ab", "a\nb", "a\rb", "a b", "a\u0085b", "axb", "5", "d:", "[digit]", "5x", "ax", "&c", "ac", "bc", "x{,3}", "xxx", "xx", "xy", "xxy", "aab", "EXCEPT", "Except", "exceptſ", "kx", "Kx", "Kx", "k5", "M7", "L1", "strasse", "STRASſE",
    "b\na", "a\nb\n", "b", "cb", "foo", "foo bar", "éfoo", "xfoo", "foo_", "oo", "a b!", "a !", "zz", "1z", "_z", "q", "\nq", "]b", "ab]", "-c", "]d", "\\d", "a.b", "a.bc", "a.bbc", "AB", "A", "\t\n", "éx", "1x", "Ay", "ay", "1z", "αβ", "α2", "12", "ababc", "c", "bbac",
    "a{b", "{a}", "a}b", "y", "éa", "éb", ".*+", "#noqa", "#\x0bnoqa", "# \tnoqa", "catch {}", "catch\x0b{}", "aB", "Ab", "AB", "abcd", " !", "x!", "-!", "7!", "K1", "k1", "j1", "K1", "日本", "日b",
]


def test_as_another_engine_finds(spark):
    frame = spark.createDataFrame([(n, s) for n, s in enumerate(STRINGS)], "n int, s string")
    got = frame.select("n", *[frame["s"].rlike(to_java(p)).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    db = duckdb.connect()
    for i, p in enumerate(PATTERNS):
        want = {s: db.execute("SELECT regexp_matches(?, ?)", [s, p]).fetchall()[0][0] for s in STRINGS}
        assert {STRINGS[r["n"]]: r[f"p{i}"] for r in got} == want, (p, to_java(p))


def test_every_match_holds_a_needle():
    db = duckdb.connect()
    for p in PATTERNS:
        if (own := needles(p)) is not None:
            for s in STRINGS:
                assert not db.execute("SELECT regexp_matches(?, ?)", [s, p]).fetchall()[0][0] or any(x in s for x in own), (p, s, own)


BAD = [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(?>a)", r"a**", r"a*+", r"a++", r"\1", r"\k", r"\Z", r"\G", r"(?P<n>a)(?P<n>b)", r"x{1001}", r"x{3,2}", r"[a", r"[]", r"[z-a]", r"[[:foo:]]", r"(a", r"a)", r"\p{Foo}", "\\", r"*a", r"|*", r"(?z)a", r"\xzz", r"\8"]


@pytest.mark.parametrize("pattern", BAD)
def test_refused(pattern):
    with pytest.raises(ValueError):
        to_java(pattern)


def test_rule_tables(spark):
    lines = spark.createDataFrame([(n, "p", 1, s) for n, s in enumerate(STRINGS)] + [(999, "p", 1, None)], "change_id long, path string, line_no int, text string")
    rules = spark.createDataFrame([(f"r{n}", p, "warn") for n, p in enumerate(PATTERNS)], "rule_id string, pattern string, severity string")
    got = {(r["change_id"], r["rule_id"]) for r in rule_tables.found(lines, rules).collect()}
    db = duckdb.connect()
    assert got == {(n, f"r{i}") for n, s in enumerate(STRINGS) for i, p in enumerate(PATTERNS) if db.execute("SELECT regexp_matches(?, ?)", [s, p]).fetchall()[0][0]}
    assert rule_tables.found(lines, rules.limit(0)).count() == 0
    with pytest.raises(ValueError, match="b1.*b2"):
        rule_tables.compiled(spark.createDataFrame([("b2", "(?=a)", "warn"), ("b1", "[a", "warn"), ("ok", "a", "warn")], "rule_id string, pattern string, severity string"))
    with pytest.raises(ValueError, match="more than 3"):
        rule_tables.compiled(rules, 3)
