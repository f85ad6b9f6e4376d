"""Patch text and git's NUL-delimited listings as tables, with window functions instead of a line-by-line machine.

A patch's lines depend on all before them. What a run of lines hands on is small (how far its last hunk has come, the header it waits
with, the file it is in), and what two runs hand on together follows from what each does: so runs are read by themselves, their
hand-overs are put together in order, a row a run, and each run is then finished with what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from palisade.sources.tables import settled

BINARY = r"^Binary files (.+?) and (.+) differ$"
HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
#: Positions of a patch given by lines that one window holds.
BLOCK = 65_536


def here(rows: DataFrame, to: int = 0) -> WindowSpec:
    """A block's rows up to this one, or to the one before it. Without blocks, rows stay where their text was, if it was dealt out by its key."""
    by = ["_key", "_block"] if "_block" in rows.columns else rows.schema["_key"].dataType.names
    return Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, to)


def before() -> WindowSpec:
    return Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def last(column: str | Column) -> Column:
    return F.last(column, ignorenulls=True)


def in_blocks(patches: DataFrame, key: tuple[str, ...], block: int | None) -> DataFrame:
    """``key..., _key, pos, raw``, and ``_block`` if there are blocks."""
    rows = patches.select(*key, F.col("pos").cast("long").alias("pos"), "raw") if "raw" in patches.columns else patches.select(*key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("_key", F.struct(*key))
    return rows.withColumn("_block", F.floor(F.col("pos") / block)) if block else rows


def handed(rows: DataFrame, block: int | None, before_blocks) -> DataFrame:
    """``rows`` with what their block gets from those before it; nothing if a patch is one block."""
    if block:
        # Written once, since both what a block hands on and its rows are made from it.
        rows = settled(rows, "patch-blocks")
        return rows.join(before_blocks(rows), ["_key", "_block"], "left")
    none = before_blocks(rows.withColumn("_block", F.lit(0))).schema
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in none if f.name not in ("_key", "_block")})


def hunks_within(rows: DataFrame) -> DataFrame:
    """Old and new lines since the block's beginning, and the block's last hunk header with these counts at it."""
    hunk = F.col("raw").rlike(HUNK)
    sign = F.substring("raw", 1, 1)
    number = lambda n, default: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("raw", HUNK, n), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(default).cast("long"))
    count = lambda *s: F.sum((~hunk & sign.isin(*s)).cast("long")).over(here(rows))
    rows = rows.withColumns({"sign": sign, "hunk": hunk, "_o": count(" ", "-"), "_n": count(" ", "+")})
    h = F.struct(number(1, None).alias("old_start"), number(2, 1).alias("old_len"), number(3, 0).alias("new_start"), number(4, 1).alias("new_len"), F.col("_o").alias("o"), F.col("_n").alias("n"))
    return rows.withColumn("_h", last(F.when(F.col("hunk"), h)).over(here(rows)))


def hunks_before(rows: DataFrame) -> DataFrame:
    """What each block gets from those before it: their old and new lines, and the last hunk header, with the lines before that."""
    ends = rows.groupBy("_key", "_block").agg(F.max_by(F.struct("_o", "_n", "_h"), "pos").alias("e"))
    ends = ends.withColumns({f"_{c}0": F.coalesce(F.sum(f"e._{c}").over(before()), F.lit(0)) for c in "on"})
    h = F.when(F.col("e._h").isNotNull(), F.col("e._h").withField("o", F.col("e._h.o") + F.col("_o0")).withField("n", F.col("e._h.n") + F.col("_n0")))
    return ends.select("_key", "_block", "_o0", "_n0", last(h).over(before()).alias("_h0"))


def with_hunks(rows: DataFrame, block: int | None) -> DataFrame:
    """``rows`` with ``sign, hunk, h, o, n, body``: the hunk that a row is in or behind, the old and new lines since its header, and whether the row is one of them."""
    found = handed(hunks_within(rows), block, hunks_before)
    own = F.col("_h").isNotNull()
    since = lambda c: F.when(own, F.col(f"_{c}") - F.col(f"_h.{c}")).otherwise(F.col(f"_{c}0") + F.col(f"_{c}") - F.col(f"_h0.{c}"))
    found = found.withColumns({"h": F.coalesce("_h", "_h0"), "o": since("o"), "n": since("n")})
    body = ~F.col("hunk") & (F.col("o") <= F.col("h.old_len")) & (F.col("n") <= F.col("h.new_len")) & F.col("sign").isin(" ", "+", "-")
    return found.withColumn("body", F.coalesce(body, F.lit(False))).drop("_o", "_n", "_h", "_o0", "_n0", "_h0")


def opened(old: Column, new: Column, is_binary: bool) -> Column:
    return F.struct(F.col("pos"), old.alias("old"), new.alias("new"), F.lit(is_binary).alias("is_binary"))


def files_within(rows: DataFrame) -> DataFrame:
    """The headers of ``rows``: ``_head``, ``_waits`` (the header before it in its block) and the file that a row opens by what its block has."""
    header = lambda mark: F.when(~F.col("body") & F.col("raw").startswith(mark), F.regexp_replace(F.expr(f"substring(raw, {len(mark) + 1})"), "\t$", ""))
    head = lambda path, is_old: F.when(path.isNotNull(), F.struct(F.lit(is_old).alias("is_old"), path.alias("path")))
    rows = rows.withColumn("_head", F.coalesce(head(header("--- "), True), head(header("+++ "), False)))
    rows = rows.withColumn("_waits", last("_head").over(here(rows, -1)))
    binary = F.when(~F.col("body") & F.col("raw").rlike(BINARY), opened(F.regexp_extract("raw", BINARY, 1), F.regexp_extract("raw", BINARY, 2), True))
    paired = F.when(~F.col("_head.is_old") & F.col("_waits.is_old"), opened(F.col("_waits.path"), F.col("_head.path"), False))
    return rows.withColumn("opened", F.coalesce(paired, binary))


def files_before(rows: DataFrame) -> DataFrame:
    """What each block gets from those before it: the header that waits, how many files were opened, and the last of them."""
    # A new header that is its block's first may go with an old one of an earlier block.
    first = F.when(~F.col("_head.is_old") & F.col("_waits").isNull(), F.struct("pos", F.col("_head.path").alias("new")))
    ends = rows.groupBy("_key", "_block").agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("pos"))).alias("head"), F.min(first).alias("first"), F.count("opened").alias("n"), F.max("opened").alias("at"))
    ends = ends.withColumn("_waits0", last("head").over(before()))
    late = F.when(F.col("_waits0.is_old") & F.col("first").isNotNull(), F.struct("first.pos", F.col("_waits0.path").alias("old"), "first.new", F.lit(False).alias("is_binary")))
    ends = ends.withColumn("late", late)
    n = F.coalesce(F.sum(F.col("n") + F.col("late").isNotNull().cast("long")).over(before()), F.lit(0))
    return ends.select("_key", "_block", "_waits0", n.alias("_files0"), last(F.greatest("at", "late")).over(before()).alias("_at0"))


def stepped(patches: DataFrame, *key: str, block: int | None = None) -> DataFrame:
    """The rows of ``patches(key..., text)``, or of lines ``(key..., pos, raw)`` numbered from 0: ``pos, raw, sign, h, o, n, body, hunk``, with ``path`` of the file they belong to and ``file_ord``.

    A hunk's header says how many old and new lines follow; rows within these counts are its body, whatever they
    begin with, so text that looks like a header is text. A file begins at its new header, if the header before it is an old one, or where binary
    files are said to differ. A text is one row, so one window's partition as well, unless ``block`` is given. Lines, and texts with ``block``, are read in runs of so many positions, each
    a window's partition: a patch of any length is then many tasks' work, and only a row a run is gathered. Positions must not repeat within a key, and may leave gaps; a null text has no rows; null keys are keys.
    """
    if block is None and "raw" in patches.columns:
        block = BLOCK
    found = handed(files_within(with_hunks(in_blocks(patches, key, block), block)), block, files_before)
    late = F.when(~F.col("_head.is_old") & F.col("_waits").isNull() & F.col("_waits0.is_old"), opened(F.col("_waits0.path"), F.col("_head.path"), False))
    found = found.withColumn("opened", F.coalesce("opened", late))
    found = found.withColumns({"file_ord": F.coalesce("_files0", F.lit(0)) + F.count("opened").over(here(found)), "_at": F.coalesce(last("opened").over(here(found)), F.col("_at0"))})
    bare = lambda c: F.when(F.col(c) == "/dev/null", None).otherwise(F.regexp_replace(c, "^[ab]/", ""))
    return found.withColumns({"new_path": bare("_at.new"), "old_path": bare("_at.old"), "is_binary": F.col("_at.is_binary")}).withColumn("path", F.coalesce("new_path", "old_path"))


def patch_lines(patches: DataFrame, *key: str, block: int | None = None) -> DataFrame:
    """Added and removed lines of ``patches(key..., text)``, or of lines ``(key..., pos, raw)``: ``key..., path, op, line_no, text``.

    ``line_no`` is the new file's for ``+``, the old file's for ``-``; context counts. A deleted file's lines have its old path.
    """
    rows = stepped(patches, *key, block=block)
    at = F.when(F.col("sign") == "+", F.col("h.new_start") + F.col("n") - 1).otherwise(F.col("h.old_start") + F.col("o") - 1)
    return rows.where(F.col("body") & F.col("sign").isin("+", "-")).select(*key, "path", F.col("sign").alias("op"), at.alias("line_no"), F.expr("substring(raw, 2)").alias("text"))


def patch_files(patches: DataFrame, *key: str, block: int | None = None) -> DataFrame:
    """Files of ``patches(key..., text)``, or of lines ``(key..., pos, raw)``: ``key..., file_ord, path, old_path, kind, added, removed, is_binary``.

    A new header without an old one before it opens no file. Kinds follow from the headers: no old file, no new file, two
    paths, or else a modified file.
    """
    rows = stepped(patches, *key, block=block).where("file_ord > 0")
    count = lambda sign: F.count_if(F.col("body") & (F.col("sign") == sign))
    out = rows.groupBy(*key, "file_ord").agg(*[F.first(c).alias(c) for c in ("path", "old_path", "new_path", "is_binary")], count("+").alias("added"), count("-").alias("removed"))
    kind = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").when(F.col("old_path") != F.col("new_path"), "renamed").otherwise("modified")
    return out.select(*key, F.col("file_ord").cast("int").alias("file_ord"), "path", F.when(kind == "renamed", F.col("old_path")).alias("old_path"), kind.alias("kind"), "added", "removed", "is_binary")


def name_status(listings: DataFrame, *key: str) -> DataFrame:
    """``git diff --name-status -z`` output of ``listings(key..., text)``: ``key..., path, old_path, kind``.

    Renames and copies name two paths; letters other than A, D, R and C stand for a modified file.
    """
    entry = F.explode(F.regexp_extract_all("text", F.lit(r"[RC][0-9]*\x00[^\x00]+\x00[^\x00]+|[ABDMTUX][0-9]*\x00[^\x00]+"), F.lit(0)))
    parts = listings.select(*key, entry.alias("entry")).select(*key, F.split("entry", "\\x00").alias("p"))
    letter = F.substring(F.col("p")[0], 1, 1)
    kind = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter.isin("R", "C"), "renamed").otherwise("modified")
    return parts.select(*key, F.element_at("p", -1).alias("path"), F.when(F.size("p") > 2, F.col("p")[1]).alias("old_path"), kind.alias("kind"))


def assembled(counts: DataFrame, kinds: DataFrame, lines: DataFrame, *key: str) -> DataFrame:
    """Changed files from three listings: counts decide which there are, kinds and added lines are joined by path.

    A file without a kind is modified; one without content has no lines. ``lines``: an array of number and text, in order.
    """
    content = lines.groupBy(*key, "path").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("lines"))
    named = kinds.select(*key, "path", F.col("kind").alias("_kind"), F.col("old_path").alias("_old"))
    own = counts if "old_path" in counts.columns else counts.withColumn("old_path", F.lit(None).cast("string"))
    out = own.join(named, [*key, "path"], "left").join(content, [*key, "path"], "left")
    kind = F.coalesce("_kind", F.when(F.col("old_path").isNotNull(), "renamed").otherwise("modified"))
    return out.select(*key, "path", F.coalesce("old_path", "_old").alias("old_path"), kind.alias("kind"), "added", "removed", "is_binary", F.coalesce("lines", F.array().cast(content.schema["lines"].dataType)).alias("lines"))


def numstat(listings: DataFrame, *key: str) -> DataFrame:
    """``git diff --numstat -z`` output of ``listings(key..., text)``: ``key..., path, old_path, added, removed, is_binary``.

    Entries end in NUL; a rename has an empty path, then the old and the new one.
    """
    joined = F.regexp_replace("text", "(?<![^\\x00])([0-9-]+\t[0-9-]+\t)\\x00([^\\x00]+)\\x00([^\\x00]+)", "$1$3\t$2")
    entry = F.explode(F.filter(F.split(joined, "\\x00"), lambda x: x != ""))
    parts = listings.select(*key, entry.alias("entry")).select(*key, F.split("entry", "\t").alias("p")).where(F.size("p") >= 3)
    number = lambda i: F.coalesce(F.expr(f"try_cast(p[{i}] AS bigint)"), F.lit(0).cast("long"))
    return parts.select(*key, F.col("p")[2].alias("path"), F.get("p", F.lit(3)).alias("old_path"), number(0).alias("added"), number(1).alias("removed"), (F.col("p")[0] == "-").alias("is_binary"))
