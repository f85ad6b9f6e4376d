"""Rules given as a table: thousands of patterns over added lines without a plan of as many branches."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.re2 import needles, to_java

#: Rules that one table may hold: they are a policy, written by people, and go to every task.
MOST = 10_000


@lru_cache(4)
def automaton(known: tuple[tuple[str, tuple[int, ...]], ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, rules in known:
        out.add_word(text, rules)
    out.make_automaton()
    return out


def compiled(rules: DataFrame, most: int = MOST) -> list[tuple[str, str, str, set[str] | None]]:
    """``(rule_id, severity, Java pattern, needles)`` of ``rules(rule_id, pattern, severity)``; ValueError names all bad patterns, twice given ids, or too many rules."""
    rows = rules.select("rule_id", "pattern", "severity").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    bad, out = [], []
    for r in sorted(rows):
        try:
            out.append((r["rule_id"], r["severity"], to_java(r["pattern"]), needles(r["pattern"])))
        except ValueError as e:
            bad.append(f"{r['rule_id']}: {e}")
    ids = [r[0] for r in out]
    bad += [f"{x}: given twice" for x in sorted({x for x in ids if ids.count(x) > 1})] if len(set(ids)) < len(ids) else []
    if bad:
        raise ValueError("; ".join(bad))
    return out


def found(lines: DataFrame, rules: DataFrame, most: int = MOST) -> DataFrame:
    """``change_id, path, line_no, rule_id, severity``: every line of ``lines(change_id, path, line_no, text)`` that a rule finds, once a rule.

    What a pattern's matches must hold is read off its syntax tree; one automaton over all these texts says which rules a line is a candidate for, and only those are tried on it.
    Rules without such a text are tried on every line. Null texts have no findings.
    """
    some = compiled(rules, most)
    by: dict[str, list[int]] = {}
    for n, (*_, own) in enumerate(some):
        for text in own or ():
            by.setdefault(text, []).append(n)
    known = tuple((t, tuple(ns)) for t, ns in sorted(by.items()))
    always = [n for n, (*_, own) in enumerate(some) if own is None]

    @F.pandas_udf("array<int>")
    def candidates(texts: pd.Series) -> pd.Series:
        if not known:
            return texts.map(lambda t: always if t is not None else [])
        machine = automaton(known)
        return texts.map(lambda t: [] if t is None else sorted({n for _, ns in machine.iter(t) for n in ns}.union(always)))

    spark = lines.sparkSession
    table = spark.createDataFrame([(n, i, s, p) for n, (i, s, p, _) in enumerate(some)], "_n int, rule_id string, severity string, _java string")
    tried = lines.select("change_id", "path", "line_no", "text", F.explode(candidates("text")).alias("_n"))
    # The table is bounded by ``most`` rows.
    return tried.join(F.broadcast(table), "_n").where("text rlike _java").select("change_id", "path", "line_no", "rule_id", "severity")
