"""What a range of commits changes in all: edit scripts of its commits composed, by path, in their order.

A script says where each run of a file's new lines is from: the old file, or a commit that wrote it. Two scripts in a row make one, and it doesn't matter
which neighbours come together first, so a path's scripts are folded in rounds, a few neighbours at a time, whatever the number of its commits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scans import running
from palisade.sources.tables import dropped, settled, swept

#: Scripts that come together in a round, and lines whose places are ranked in one window.
FAN, BLOCK = 16, 4096
#: Rows that a task hands back at a time, about.
OUT = 20_000
#: Beyond every file's end.
END = 2**40
#: A run of new lines: first line, length, the commit that wrote it (null: the old file), and its first line there.
RUN = "start long, len long, src long, at long"

Run = tuple[int, int, int | None, int]


def script(added: list[tuple[int, int]], removed: list[tuple[int, int]], commit: int) -> list[Run]:
    """The script of one commit, of runs ``(first, length)`` of lines it added to the new file and removed from the old."""
    out: list[Run] = []
    new, old, gone = 1, 1, sorted(removed, reverse=True)
    for first, size in [*sorted(added), (END, 0)]:
        while new < first:
            while gone and gone[-1][0] <= old:
                old = max(old, sum(gone.pop()))
            kept = min(first - new, (gone[-1][0] if gone else END) - old)
            if kept <= 0:
                break
            out.append((new, kept, None, old))
            new, old = new + kept, old + kept
        if size:
            out.append((first, size, commit, first))
            new = first + size
    return out


def composed(first: list[Run], second: list[Run]) -> list[Run]:
    """One script for two: what ``second`` keeps of its old file is looked up in ``first``."""
    starts = [r[0] for r in first]
    out: list[Run] = []
    for start, size, src, at in second:
        if src is not None:
            out.append((start, size, src, at))
            continue
        n = max(0, bisect_right(starts, at) - 1)
        while size > 0 and n < len(first):
            begin, length, source, place = first[n]
            skip = at - begin
            if skip >= length:
                n += 1
                continue
            take = min(size, length - skip)
            last = out[-1] if out else None
            if last and last[2] == source and last[0] + last[1] == start and last[3] + last[1] == place + skip:
                out[-1] = (last[0], last[1] + take, source, last[3])
            else:
                out.append((start, take, source, place + skip))
            start, at, size, n = start + take, at + take, size - take, n + 1
    return out


def runs_of(lines: DataFrame, *key: str) -> DataFrame:
    """Runs ``(key..., op, start, len)`` of ``lines(key..., op, line_no)`` without gaps; cut at multiples of ``BLOCK``, so no window holds more lines than that."""
    at = Window.partitionBy(*key, "op", F.expr(f"line_no div {BLOCK}")).orderBy("line_no")
    island = lines.select(*key, "op", "line_no", (F.col("line_no") - F.row_number().over(at)).alias("_island"), F.expr(f"line_no div {BLOCK}").alias("_block"))
    return island.groupBy(*key, "op", "_block", "_island").agg(F.min("line_no").alias("start"), F.count("*").alias("len")).drop("_block", "_island")


def folded(runs: DataFrame) -> DataFrame:
    """``(key, side, path, start, len, src, at)``: the one script of each path; ``runs(key, side, path, ord, commit, added, start, len)``, a written table, with ``ord`` from 0 without gaps."""

    def one(own: list[tuple]) -> list[Run]:
        own = list(own)
        pairs = lambda added: [(x[7], x[8]) for x in own if x[6] == added]
        return script(pairs(True), pairs(False), own[0][5])

    def more(own: list[tuple]) -> list[Run]:
        return [(x[5], x[6], x[7], x[8]) for x in own]

    def task(read):
        """Rows come in order of their groups, so a task holds one group at a time, whatever their number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind: list[pa.DataType] = []

            def rows():
                for batch in batches:
                    kind[:] = [batch.schema.field("key").type]
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

            def flush() -> pa.RecordBatch:
                types = [*kind, pa.int32(), pa.string(), *[pa.int64()] * 5]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], ["key", "side", "path", "ord", "start", "len", "src", "at"])

            made: list[tuple] = []
            for head, group in groupby(rows(), itemgetter(0, 1, 2, 3)):
                out = None
                for _, own in groupby(group, itemgetter(4)):
                    out = read(own) if out is None else composed(out, read(own))
                made += [(*head, *r) for r in out]
                if len(made) >= OUT:
                    yield flush()
                    made.clear()
            if made:
                yield flush()

        return run

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        head = ["key", "side", "path", "node"]
        rows = rows.withColumn("node", F.expr(f"ord div {FAN}")).select(*head, "ord", *columns)
        return rows.repartition(*head).sortWithinPartitions(*head, "ord", "start")

    fields = f"key {runs.schema['key'].dataType.simpleString()}, side int, path string, ord long, {RUN}"
    most = runs.agg(F.max("ord")).first()[0]
    made = settled(dealt(runs, "commit", "added", "start", "len").mapInArrow(task(one), fields), "scripts")
    while most is not None and (most := most // FAN) > 0:
        before, made = made, settled(dealt(made, "start", "len", "src", "at").mapInArrow(task(more), fields), "scripts")
        dropped(before)
    return made.drop("ord")


def net_lines(lines: DataFrame, trim: bool = True) -> DataFrame:
    """``key, path, op, line_no, text``: the lines that a range adds (``+``, by their place in its last state) and removes (``-``, by their place in its first).

    ``lines(key, seq, commit, path, op, line_no, text)``: what each commit of range ``key`` does to a path, in order of ``seq``; a key's commits follow each other, as along
    first parents. A line that one commit adds and a later one removes counts for nothing. With ``trim``, text that is taken out and put back in at the same place
    doesn't count either, as far as a gap's removed and added lines agree from its start or to its end. A renamed file counts under both its paths. No lines give no rows.
    """
    return net_of(settled(lines.select("key", "seq", "commit", "path", "op", F.col("line_no").cast("long").alias("line_no"), "text"), "lines"), trim)


def net_of(lines: DataFrame, trim: bool = True) -> DataFrame:
    """:func:`net_lines` of a written table, which is read several times."""
    runs = settled(runs_of(lines, "key", "seq", "commit", "path"), "runs")
    order = runs.select("key", "path", "seq").distinct()
    # A path's commits: few for most, but a log that each commit touches is ranked in blocks too.
    order = running(order, ["key", "path"], "seq", F.expr(f"seq div {BLOCK}"), n=("sum", F.lit(1))).withColumn("ord", F.col("n") - 1).drop("n")
    order = settled(order, "order")
    total = order.groupBy("key", "path").agg(F.count("*").alias("n"))
    # Tables of few MB on disk may be millions of rows: none of them goes through the driver.
    own = runs.join(order.join(total.hint("merge"), ["key", "path"]).hint("merge"), ["key", "path", "seq"])
    ahead, behind = F.col("ord").cast("long"), (F.col("n") - 1 - F.col("ord")).cast("long")
    # Seen from the last state backwards, lines are added that were removed.
    both = [F.struct(F.lit(side).alias("side"), at.alias("ord"), (F.col("op") == op).alias("added")) for side, at, op in ((0, ahead, "+"), (1, behind, "-"))]
    both = settled(own.withColumn("_s", F.explode(F.array(*both))).select("key", "_s.side", "path", "_s.ord", "commit", "_s.added", "start", "len"), "sides")
    swept(lines.sparkSession)
    net = folded(both)
    # The gap of the first state that lines stand in: after its last line that stays before them, which is so far on in their own state.
    end = F.col("start") + F.col("len") - 1
    kept = F.when(F.col("src").isNull(), F.struct(F.when(F.col("side") == 0, F.col("at") + F.col("len") - 1).otherwise(end).alias("gap"), end.alias("own")))
    net = running(net, ["key", "side", "path"], "start", F.expr(f"start div {BLOCK}"), _gap=("last", kept)).where("src is not null")
    each = net.select("key", "side", "path", "_gap", F.col("src").alias("commit"), F.posexplode(F.sequence("start", end)).alias("_n", "line_no"), "at")
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = each.select("key", "path", F.when(F.col("side") == 0, "+").otherwise("-").alias("op"), zero("_gap.gap").alias("gap"), (F.col("line_no") - zero("_gap.own")).alias("k"), "line_no", "commit", (F.col("at") + F.col("_n")).alias("_at"))
    texts = lines.select("key", "path", "op", "commit", F.col("line_no").alias("_at"), "text")
    found = settled(each.join(texts.hint("merge"), ["key", "path", "op", "commit", "_at"]).select("key", "path", "op", "gap", "k", "line_no", "text"), "net")
    dropped(lines, runs, order, both)
    return (untouched(found) if trim else found).select("key", "path", "op", "line_no", "text")


def untouched(found: DataFrame) -> DataFrame:
    """``found(key, path, op, gap, k, line_no, text)``, a written table, without the lines of a gap that its removed and added ones share, counted from either end up to the first that differs.

    ``k`` counts a gap's lines of either kind from 1. Long gaps are dealt out by line.
    """
    keys = ["key", "path", "gap"]
    # Only gaps with both can agree.
    sizes = found.groupBy(*keys).agg(F.max(F.when(F.col("op") == "-", F.col("k"))).alias("_old"), F.max(F.when(F.col("op") == "+", F.col("k"))).alias("_new"))
    rows = settled(found.join(sizes.where("_old is not null and _new is not null").hint("merge"), keys), "mixed")
    old, new = (rows.where(F.col("op") == op) for op in "-+")
    most = F.least("_old", "_new")

    def shared(shift, place, name: str) -> DataFrame:
        """How many lines agree, of those ``shift`` further on in the new state, up to the first ``place`` that doesn't."""
        left = old.select(*keys, (F.col("k") + shift).alias("k"), place.alias("_place"), most.alias("_most"), F.col("text").alias("_a"))
        both = left.join(new.select(*keys, "k", F.col("text").alias("_b")).hint("merge"), [*keys, "k"])
        off = F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("_place") - 1))
        return both.groupBy(*keys).agg(F.coalesce(off, F.max("_most")).alias(name))

    shift = F.col("_new") - F.col("_old")
    same = shared(F.lit(0), F.col("k"), "_lo").join(shared(shift, F.col("_old") - F.col("k") + 1, "_hi").hint("merge"), keys).where("_lo + _hi > 0")
    left = rows.select(*found.columns, "_old", "_new").join(same.hint("merge"), keys)
    # What agrees from the start isn't counted from the end again.
    last = F.when(F.col("op") == "-", F.col("_old")).otherwise(F.col("_new"))
    gone = left.where((F.col("k") <= F.col("_lo")) | (F.col("k") > last - F.least(F.col("_hi"), most - F.col("_lo")))).select("key", "path", "op", "line_no")
    return found.join(gone.hint("merge"), ["key", "path", "op", "line_no"], "left_anti")


def net_files(net: DataFrame, files: DataFrame) -> DataFrame:
    """``key, path, kind, added, removed`` of :func:`net_lines` and of ``files(key, seq, path, kind)``, what each commit does to a file.

    A file is added if its first commit adds it, deleted if its last one deletes it, else modified; one that comes and goes within the range isn't listed,
    nor is one that ends as it began.
    """
    ends = files.groupBy("key", "path").agg(F.min_by("kind", "seq").alias("_first"), F.max_by("kind", "seq").alias("_last"))
    counts = net.groupBy("key", "path").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))
    born, gone = F.col("_first") == "added", F.col("_last") == "deleted"
    kind = F.when(born, "added").when(gone, "deleted").otherwise("modified")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = ends.join(counts, ["key", "path"], "left").where(~(born & gone)).select("key", "path", kind.alias("kind"), zero("added"), zero("removed"))
    return out.where((F.col("kind") != "modified") | (F.col("added") + F.col("removed") > 0))
