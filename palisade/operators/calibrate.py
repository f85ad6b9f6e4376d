"""Calibration over history: fitted budgets, rule precision, ratchets, drift and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.globs import matches_any
from palisade.functions.re2 import to_java
from palisade.functions.scans import running
from palisade.sources import code


def fitted_budget(files: DataFrame, *by: str) -> DataFrame:
    """Twice the exact 75th percentile of changed lines a change."""
    sizes = files.groupBy("change_id", *by).agg(F.sum(F.col("added") + F.col("removed")).alias("lines"))
    return sizes.groupBy(*by).agg(F.percentile("lines", 0.75).alias("p75"), F.count("*").alias("n_changes")).withColumn("suggested", (2 * F.col("p75")).cast("double"))


def precision(flagged: DataFrame, head: DataFrame, least: int, demote_at: float) -> DataFrame:
    """By rule: flagged lines, and the share that is gone from the latest state; rules that few act on are to be demoted."""
    left = flagged.join(head.select("change_id", "path", "line_no", F.col("text").alias("_text")), ["change_id", "path", "line_no"], "left")
    acted = (F.col("_text").isNull() | (F.col("_text") != F.col("text"))).cast("double")
    out = left.groupBy("rule_id").agg(F.count("*").alias("samples"), F.avg(acted).alias("acted_rate"))
    return out.withColumn("demote", (F.col("samples") >= least) & (F.col("acted_rate") <= demote_at))


def ratchet(now: DataFrame, before: DataFrame, *by: str) -> DataFrame:
    """Counts against a baseline: fails only where they rise."""
    both = now.withColumnRenamed("n", "n_now").join(before.withColumnRenamed("n", "n_before"), list(by), "full_outer")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_now", "n_before")})
    return both.withColumn("failed", F.col("n_now") > F.col("n_before"))


def net_new(now: DataFrame, before: DataFrame, *by: str) -> DataFrame:
    """The names that the baseline lacks."""
    return now.join(before.select(*by).distinct(), list(by), "left_anti").select(*by).distinct()


def demotions(audited: DataFrame, current: dict[str, str]) -> DataFrame:
    """``rule_id, severity``: rules to be demoted from error to warn; none is ever promoted, other severities stay."""
    errors = [r for r, s in current.items() if s == "error"]
    return audited.where(F.col("demote") & F.col("rule_id").isin(*errors)).select("rule_id", F.lit("warn").alias("severity"))


def style(name: Column) -> Column:
    """How a name is written; a single word in small letters says nothing."""
    return (
        F.when(name.rlike("^[a-z][a-z0-9]*\\z"), F.lit(None)).when(name.rlike("^[a-z0-9]+(?:_[a-z0-9]+)+\\z"), "snake")
        .when(name.rlike("^[a-z0-9]+(?:-[a-z0-9]+)+\\z"), "kebab").when(name.rlike("^[a-z][A-Za-z0-9]*\\z"), "camel")
        .when(name.rlike("^[A-Z][A-Za-z0-9]*\\z"), "pascal").otherwise("other")
    )


def drift(rows: DataFrame, group: str, form: str, share: float) -> DataFrame:
    """Rows whose form isn't the one that at least ``share`` of their group has; rows without a form count nowhere, and a group without such a majority says nothing."""
    known = rows.where(F.col(form).isNotNull())
    return known.join(dominant(known, group, form, share), group).where(F.col(form) != F.col("dominant"))


def fingerprint(functions: DataFrame, language: str = "lang") -> DataFrame:
    """By language: number of functions, mean size and commonest style of name, of ``functions(lang, name, size)``."""
    named = functions.withColumn("style", style(F.col("name")))
    styles = named.where("style is not null").groupBy(language, "style").agg(F.count("*").alias("n")).groupBy(language).agg(F.max_by("style", F.struct("n", "style")).alias("style"))
    sizes = named.groupBy(language).agg(F.count("*").alias("n_functions"), F.avg("size").alias("mean_size"))
    return sizes.join(styles, language, "left")


def architecture(lines: DataFrame, rules: list[dict], languages: tuple[str, ...]) -> DataFrame:
    """``change_id, path, line_no, rule_id`` of lines of a rule's language whose call its pattern finds outside the paths that may.

    A rule: ``id, lang, pattern, allowed`` (patterns of paths). A language that isn't among ``languages`` is an error.
    """
    hits = []
    for r in rules:
        if r["lang"] not in languages:
            raise ValueError(f"unknown language {r['lang']!r} in rule {r['id']!r}")
        hits.append(F.when((F.col("lang") == r["lang"]) & F.col("text").rlike(to_java(r["pattern"])) & ~matches_any(F.col("path"), r["allowed"]), F.lit(r["id"])))
    return lines.select("change_id", "path", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("rule_id"))


def entropy(text: Column) -> Column:
    """Bits a sign of a string, by how often each sign occurs in it."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(signs).cast("double")
    share = lambda c: F.size(F.filter(signs, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def secrets(lines: DataFrame, shapes: dict[str, str], least_entropy: float = 4.0, least_length: int = 20) -> DataFrame:
    """``change_id, path, line_no, rule_id, severity``: lines with a known shape of key are errors, quoted strings of high entropy warnings."""
    known = [F.when(F.col("text").rlike(to_java(p)), F.struct(F.lit(f"secret/{n}").alias("rule_id"), F.lit("error").alias("severity"))) for n, p in shapes.items()]
    quoted = F.regexp_extract_all("text", F.lit(rf"[\"']([A-Za-z0-9+/_=-]{{{least_length},}})[\"']"), F.lit(1))
    odd = F.when(F.exists(quoted, lambda x: entropy(x) >= least_entropy), F.struct(F.lit("secret/entropy").alias("rule_id"), F.lit("warn").alias("severity")))
    found = lines.select("change_id", "path", "line_no", F.explode(F.array_compact(F.array(*known, odd))).alias("r"))
    return found.select("change_id", "path", "line_no", "r.rule_id", "r.severity")


def lcov(reports: DataFrame, *key: str) -> DataFrame:
    """``key..., path, line_no, hit`` of ``reports(key..., text)`` in lcov's format: a file's lines follow its name, records end on their own line."""
    record = F.explode(F.split("text", "\nend_of_record\n?"))
    parts = reports.select(*key, record.alias("r")).select(*key, F.regexp_extract("r", "(?m)^SF:(.*)$", 1).alias("path"), F.explode(F.regexp_extract_all("r", F.lit("(?m)^DA:([0-9]+,[0-9]+)"), F.lit(1))).alias("d"))
    number = lambda i: F.get(F.split("d", ","), F.lit(i)).cast("long")
    return parts.where("path <> ''").select(*key, "path", number(0).alias("line_no"), (number(1) > 0).alias("hit"))


def go_cover(reports: DataFrame, *key: str) -> DataFrame:
    """The same of Go's cover profiles: each block covers all lines from its first to its last; a line is hit if any of its blocks is."""
    line = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(\S+:[0-9]+\.[0-9]+,[0-9]+\.[0-9]+ [0-9]+ [0-9]+)$"), F.lit(1)))
    shape = r"^(.*):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+ [0-9]+ ([0-9]+)$"
    part = lambda i: F.regexp_extract("l", shape, i)
    blocks = reports.select(*key, line.alias("l")).select(*key, part(1).alias("path"), F.explode(F.sequence(part(2).cast("long"), part(3).cast("long"))).alias("line_no"), (part(4).cast("long") > 0).alias("hit"))
    return blocks.groupBy(*key, "path", "line_no").agg(F.bool_or("hit").alias("hit"))


def cobertura(reports: DataFrame, *key: str) -> DataFrame:
    """The same of Cobertura's XML: the lines of each class, under its file's name."""
    one = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(<class\b[^>]*>.*?</class>)"), F.lit(1)))
    lines = reports.select(*key, one.alias("c")).select(*key, F.regexp_extract("c", r"<class\b[^>]*\bfilename=\"([^\"]*)\"", 1).alias("path"), F.explode(F.regexp_extract_all("c", F.lit(r"(<line\b[^>]*>)"), F.lit(1))).alias("l"))
    number = lambda name: F.regexp_extract("l", rf"\b{name}=\"([0-9]+)\"", 1).cast("long")
    return lines.groupBy(*key, "path", number("number").alias("line_no")).agg(F.bool_or(number("hits") > 0).alias("hit"))


def dominant(rows: DataFrame, group: str, form: str, share: float) -> DataFrame:
    """Each group's commonest form, if at least ``share`` of its rows have it."""
    counts = rows.groupBy(group, form).agg(F.count("*").alias("n"))
    top = counts.groupBy(group).agg(F.sum("n").alias("total"), F.max(F.struct("n", form)).alias("t"))
    return top.select(group, F.col(f"t.{form}").alias("dominant"), F.col("t.n").alias("n_dominant"), "total").where(F.col("n_dominant") >= share * F.col("total"))


def coverage(lines: DataFrame, covered: DataFrame, least_percent: int, artifacts: DataFrame | None = None) -> DataFrame:
    """By change: added lines that can be covered, those that are, whether the share is below ``least_percent``, and what became of it.

    ``covered(change_id, path, line_no, hit)``. ``artifacts(change_id, stale)`` says which changes have a report: without one nothing fails
    (``missing``), and a report older than the change is only told of (``stale``).
    """
    both = lines.select("change_id", "path", "line_no").join(covered, ["change_id", "path", "line_no"])
    out = both.groupBy("change_id").agg(F.count("*").alias("coverable"), F.count_if("hit").alias("covered"))
    below = F.col("covered") * 100 < F.col("coverable") * least_percent
    if artifacts is None:
        return out.withColumn("failed", below)
    out = lines.select("change_id").distinct().join(artifacts.select("change_id", F.lit(True).alias("_has"), "stale"), "change_id", "left").join(out, "change_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("coverable", "covered")})
    state = F.when(F.col("_has").isNull(), "missing").when(F.col("stale"), "stale").when(below, "failed").otherwise("passed")
    return out.select("change_id", "coverable", "covered", (state == "failed").alias("failed"), state.alias("state"))


def conventions(functions: DataFrame) -> DataFrame:
    """``lang, dominant, n_dominant, total, mean_size`` of ``functions(lang, name, from_line, to_line)``: what a repository's functions are like, to be kept and held against later ones."""
    rows = functions.select("lang", style(F.col("name")).alias("style"), (F.col("to_line") - F.col("from_line") + 1).alias("size"))
    named = dominant(rows.where(F.col("style").isNotNull()), "lang", "style", 0.0)
    return rows.groupBy("lang").agg(F.avg("size").alias("mean_size")).join(named, "lang", "left")


def function_drift(added: DataFrame, known: DataFrame, share: float = 0.8, factor: float = 2.0) -> DataFrame:
    """Functions of ``added`` with ``name_drifts`` or ``size_drifts``, against :func:`conventions`: a name of another style than at least ``share`` of its language's, more than ``factor`` times their mean lines.

    Where no style has that share, as in mixed repositories, no name drifts; a single word in small letters never does; of a language without functions nothing is known.
    """
    # A row a language; the functions, which are few bytes a row on disk, must not be the side that goes through the driver.
    rows = added.withColumns({"style": style(F.col("name")), "size": F.col("to_line") - F.col("from_line") + 1}).join(F.broadcast(known), "lang")
    name = F.col("style").isNotNull() & (F.col("n_dominant") >= share * F.col("total")) & (F.col("style") != F.col("dominant"))
    rows = rows.withColumns({"name_drifts": F.coalesce(name, F.lit(False)), "size_drifts": F.col("size") > factor * F.col("mean_size")})
    return rows.where("name_drifts or size_drifts")


@dataclass(frozen=True)
class Form:
    """A way to write something in a language: statements that ``begins`` finds, whose whole text ``pattern`` finds."""

    lang: str
    form: str
    begins: str
    pattern: str


#: Forms of imports and of handed-on errors; the first that fits holds.
IMPORTS = (
    Form("go", "grouped", r"^import\b", r"^import\s*\("), Form("go", "single", r"^import\b", r"^import\s"),
    *[Form(lang, form, r"^\s*import\b|\brequire\s*\(", pattern) for lang in ("typescript", "javascript") for form, pattern in (
        ("namespace", r"^import\s+\*\s+as\b"), ("named", r"^import\s+(?:type\s+)?\{"), ("default", r"^import\s+[\w$]+"), ("require", r"\brequire\s*\("))],
    Form("python", "from", r"^\s*(?:from|import)\s", r"^from\s"), Form("python", "import", r"^\s*(?:from|import)\s", r"^import\s"),
)
ERRORS = tuple(
    Form("go", form, r"^\s*return\b.*(?:\berr\b|\bErrorf\s*\(|errors\.\w+\s*\()|\bpanic\(", pattern)
    for form, pattern in (("panic", r"\bpanic\("), ("wrap", r"%w|\berrors\.Wrapf?\("), ("bare", r"^return\s+(?:.*,\s*)?err$"))
)


def statement_forms(lines: DataFrame, forms: tuple[Form, ...]) -> DataFrame:
    """``path, lang, from_line, to_line, text, form`` of the statements in ``lines(path, line_no, text)`` that have one of ``forms``, over as many lines as they take."""
    begins = {f.lang: f.begins for f in forms}
    fits = [F.when((F.col("lang") == f.lang) & F.col("text").rlike(f.pattern), F.lit(f.form)) for f in forms]
    return code.statements(lines, begins).withColumn("form", F.coalesce(*fits)).where("form is not null")


def form_counts(statements: DataFrame) -> DataFrame:
    """``lang, form, n``: the distribution to be kept."""
    return statements.groupBy("lang", "form").agg(F.count("*").alias("n"))


def form_drift(added: DataFrame, counts: DataFrame, share: float = 0.8) -> DataFrame:
    """Statements of ``added`` with a form that isn't the ``dominant`` one, which at least ``share`` of ``counts`` of their language must have; only added ones are judged."""
    top = counts.groupBy("lang").agg(F.max_by("form", F.struct("n", "form")).alias("dominant"), F.max("n").alias("_m"), F.sum("n").alias("_total"))
    return added.join(top.where(F.col("_m") >= share * F.col("_total")).select("lang", "dominant"), "lang").where(F.col("form") != F.col("dominant"))


def artifact_states(judged: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``change_id, stale`` of the changes that have a coverage report: ``judged(change_id, path, changed_at, judged_at)``, ``artifacts(path, made_at)``.

    Of each path the latest report made by the time a change is judged counts; one older than the change says nothing of it. A change is stale if a report of one of its paths
    is; without any report it has no row. The latest report is a running value over a path's events, read in blocks of a day.
    """
    events = judged.select("path", F.col("judged_at").alias("at"), "change_id", "changed_at").unionByName(artifacts.select("path", F.col("made_at").alias("at")), allowMissingColumns=True)
    events = events.withColumn("_order", F.struct("at", F.col("change_id").isNotNull().alias("asks"), "change_id"))
    made = F.when(F.col("change_id").isNull(), F.col("at"))
    last = running(events, ["path"], "_order", F.to_date("at"), made_at=("last", made)).where("change_id is not null and made_at is not null")
    return last.groupBy("change_id").agg(F.bool_or(F.col("made_at") < F.col("changed_at")).alias("stale"))
