"""Source text as tables: functions and statements found over lines, by running depths instead of syntax trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.scans import running
from palisade.sources.tables import dropped, settled

#: Lines that one window holds.
BLOCK = 4096


@dataclass(frozen=True)
class Language:
    """How a language writes functions: ``heads`` capture the name; bodies stand in braces, or deeper than their head."""

    name: str
    suffixes: tuple[str, ...]
    heads: tuple[str, ...]
    comment: str
    braces: bool = True


# What files end in, how functions begin.
SCRIPT_HEADS = (
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>\s*\{",
    r"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{\s*$",
)
LANGUAGES = (
    Language("go", ("go",), (r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",), "//"),
    Language("python", ("py",), (r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)",), "#", braces=False),
    Language("typescript", ("ts", "tsx"), SCRIPT_HEADS, "//"),
    Language("javascript", ("js", "jsx"), SCRIPT_HEADS, "//"),
)


def language(path: Column) -> Column:
    """The language of a file by what its name ends in, null for others."""
    suffix = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.coalesce(*[F.when(suffix.isin(*x.suffixes), F.lit(x.name)) for x in LANGUAGES])


def by_language(lang: Column, value) -> Column:
    return F.coalesce(*[F.when(lang == x.name, value(x)) for x in LANGUAGES])


def bare(lang: Column, text: Column) -> Column:
    """A line without its strings' content and without its comment; strings and comments over several lines aren't known to be such."""
    quoted = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`"""
    blank = lambda x: F.regexp_replace(F.regexp_replace(text, rf"({quoted})|{x.comment}.*$" + (r"|/\*.*?\*/" if x.braces else ""), r"$1"), quoted, '""')
    return by_language(lang, blank)


def depths(lines: DataFrame) -> DataFrame:
    """``lines(path, line_no, text)`` of known languages with ``lang, code, up, depth``: the line without strings and comments, the depth of brackets
    before it and after it. A file of any length is many tasks' work."""
    rows = lines.select("path", F.col("line_no").cast("long").alias("line_no"), "text", language(F.col("path")).alias("lang")).where("lang is not null")
    rows = rows.withColumn("code", bare(F.col("lang"), F.col("text")))
    n = lambda signs: F.length("code") - F.length(F.translate("code", signs, ""))
    rows = rows.withColumn("_more", n("({[") - n(")}]"))
    rows = running(rows, ["path"], "line_no", F.expr(f"line_no div {BLOCK}"), depth=("sum", F.col("_more")))
    return rows.withColumn("up", F.col("depth") - F.col("_more")).drop("_more")


def measured(lines: DataFrame) -> DataFrame:
    """:func:`depths`, written."""
    return settled(depths(lines), "measured")


def closed(rows: DataFrame, opened: Column) -> DataFrame:
    """Lines of :func:`measured` that ``opened`` holds for, with ``to_line``: the first from here on after which the depth is back at what it was before; null if none is.

    Each line says what depths it comes back to, so the next one is looked up by depth, not searched for. What is open at a depth is deeper up to its end,
    so only lines that go down say so, and those that open something and may end it themselves.
    """
    turns = rows.where(F.coalesce(opened, F.lit(False)) | (F.col("depth") < F.col("up")))
    back = F.sequence("depth", F.greatest("depth", "up"))
    events = turns.select("path", F.explode(back).alias("level"), "line_no", F.col("line_no").alias("_close"), F.lit(False).alias("_head"))
    heads = rows.where(opened).select("path", F.col("up").alias("level"), "line_no", F.lit(True).alias("_head"), F.struct(*rows.columns).alias("_row"))
    both = events.unionByName(heads, allowMissingColumns=True).withColumn("_back", F.struct((-F.col("line_no")).alias("n"), "_head"))
    found = running(both, ["path", "level"], "_back", F.floor(-F.col("line_no") / BLOCK), to_line=("last", F.col("_close")))
    return found.where("_head").select("_row.*", "to_line")


def functions(lines: DataFrame) -> DataFrame:
    """``path, lang, name, from_line, to_line`` of the functions in ``lines(path, line_no, text)``, whole files; inner ones too. A body's first brace stands on the
    head's last line; heads without one give none."""
    rows = depths(lines)
    heads = lambda x: F.coalesce(*[F.nullif(F.regexp_extract("text", h, 1), F.lit("")) for h in x.heads])
    rows = rows.withColumn("name", by_language(F.col("lang"), heads))
    braces = F.col("lang").isin(*[x.name for x in LANGUAGES if x.braces])
    # By indentation a body ends before the next line of code that is no deeper than its head; brackets over several lines don't end it.
    deep = F.when(~braces & (F.trim("code") != ""), F.length(F.regexp_extract("text", r"^[ \t]*", 0)))
    rows = rows.withColumns({"_opens": braces & F.col("name").isNotNull() & F.col("code").rlike(r"[({]\s*$|\{"), "_in": deep})
    # Of texts, nothing is written; of lines in braces, only those that open or end something.
    rows = rows.where(F.col("_in").isNotNull() | braces & (F.col("_opens") | (F.col("depth") < F.col("up"))))
    rows = settled(rows.select("path", "lang", "line_no", "name", "up", "depth", "_opens", "_in"), "measured")
    braced = closed(rows.where("_in is null").select("path", "lang", "line_no", "name", "up", "depth", "_opens"), F.col("_opens")).where("to_line is not null")
    ranked = settled(running(rows.where("_in is not null").drop("depth", "_opens"), ["path"], "line_no", F.expr(f"line_no div {BLOCK}"), _at=("sum", F.lit(1))), "ranked")
    out = settled(braced.select("path", "lang", "name", F.col("line_no").alias("from_line"), "to_line").unionByName(indented(ranked)), "functions")
    dropped(rows, ranked)
    return out


def indented(rows: DataFrame) -> DataFrame:
    """Functions by indentation, of lines of code ``(path, lang, line_no, name, up, _in, _at)`` counted by ``_at``: for every depth that a line is no deeper than, it ends what began there;
    the last line of code before it is the body's last.

    Depths are few (those at which some head of the file stands), so a line speaks for as many as are above it.
    """
    head = F.col("name").isNotNull() & (F.col("up") == 0)
    files = rows.groupBy("path").agg(F.collect_set(F.when(head, F.col("_in"))).alias("_ins"), F.max("line_no").alias("_end_line")).where("size(_ins) > 0")
    # Tables of few MB on disk may be millions of rows: none of them goes through the driver.
    own = rows.where("up = 0").join(files.hint("merge"), "path")
    # A body ends one line of code before the line that ends it.
    ends = own.select("path", F.explode(F.filter("_ins", lambda x: x >= F.col("_in"))).alias("level"), "line_no", F.col("_at").alias("_end"), F.lit(0).alias("_head"))
    heads = own.where("name is not null").select("path", F.col("_in").alias("level"), "line_no", F.lit(1).alias("_head"), F.struct("lang", "name", "_end_line").alias("_row"))
    # A head's own line ends what is before it, not itself: seen from the end of the file, it asks first.
    both = ends.unionByName(heads, allowMissingColumns=True).withColumn("_back", F.struct((-F.col("line_no")).alias("n"), (-F.col("_head")).alias("h")))
    found = running(both, ["path", "level"], "_back", F.floor(-F.col("line_no") / BLOCK), _next=("last", F.col("_end"))).where("_head = 1")
    found = found.select("path", "line_no", "_row.*", (F.col("_next") - 1).alias("_last"))
    lines = rows.select("path", F.col("_at").alias("_last"), F.col("line_no").alias("to_line"))
    return found.join(lines.hint("merge"), ["path", "_last"], "left").select("path", "lang", "name", F.col("line_no").alias("from_line"), F.greatest(F.coalesce("to_line", "_end_line"), "line_no").alias("to_line"))


def statements(lines: DataFrame, begins: dict[str, str]) -> DataFrame:
    """``path, lang, from_line, to_line, text``: statements that begin as ``begins`` (a pattern by language) says, put together over as many lines as their brackets
    are open; a line end is a space in ``text``."""
    rows = measured(lines)
    start = F.lit(False)
    for lang, pattern in begins.items():
        start = start | ((F.col("lang") == lang) & F.col("text").rlike(pattern))
    heads = closed(rows, start).withColumn("to_line", F.coalesce("to_line", "line_no")).select("path", "lang", F.col("line_no").alias("from_line"), "to_line")
    each = heads.withColumn("line_no", F.explode(F.sequence("from_line", "to_line"))).join(rows.select("path", "line_no", "text").hint("merge"), ["path", "line_no"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")))), lambda x: x["t"]), " ")
    return each.groupBy("path", "lang", "from_line", "to_line").agg(joined.alias("text"))
