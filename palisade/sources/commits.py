"""Commits: listings, ranges, what is still to be pushed, and which range a run of continuous integration looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the id that stands for no commit.
NO_COMMIT = "0" * 40


def in_order(changes: DataFrame) -> DataFrame:
    """Commits without merges, oldest first; the sort is a range partitioning of all, no window over one."""
    return changes.where("not is_merge").orderBy("committed_at", "change_id")


def staged(table: DataFrame, change_id: int) -> DataFrame:
    """The rows of one change."""
    return table.where(F.col("change_id") == change_id)


def in_ranges(changes: DataFrame, ranges: DataFrame, width: int = 1000) -> DataFrame:
    """``range_id`` and the columns of ``changes`` for each of ``ranges(range_id, base, head)`` that a change lies in: after base, up to head, by ``change_id``.

    A range is cut into steps of ``width``, so that both sides meet by an equality; one long range or many short ones stay a hash join.
    """
    steps = ranges.where("head > base").select("range_id", "base", "head", F.explode(F.sequence(F.expr(f"base div {width}"), F.expr(f"head div {width}"))).alias("_step"))
    found = changes.withColumn("_step", F.expr(f"change_id div {width}")).join(steps, "_step")
    return found.where("change_id > base and change_id <= head").select("range_id", *changes.columns)


def attributed(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings whose message names the commit, by the first seven signs of its id."""
    named = findings.join(changes.select("change_id", "tree_hash"), "change_id")
    return named.withColumn("message", F.concat("message", F.lit(" (commit "), F.substring("tree_hash", 1, 7), F.lit(")"))).drop("tree_hash")


def unpushed(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Commits that no remote branch has yet."""
    return local.join(remote.select("change_id"), "change_id", "left_anti")


def ci_ranges(runs: DataFrame) -> DataFrame:
    """``runs(run_id, given, base, head, before, after)`` with ``range``: what was given, else a pull request's base and head, else a push's commits, else the last commit."""
    has = lambda *cs: F.lit(True) if not cs else (F.coalesce(cs[0], F.lit("")) != "") & has(*cs[1:])
    span = lambda a, b: F.concat(a, F.lit(".."), b)
    pushed = has("before", "after") & (F.col("before") != NO_COMMIT)
    found = F.when(has("given"), F.col("given")).when(has("base", "head"), span("base", "head")).when(pushed, span("before", "after")).otherwise("HEAD~1..HEAD")
    return runs.select("run_id", found.alias("range"))


def manifest_of(tasks: DataFrame) -> DataFrame:
    """``tasks(change_id, flag, file, ticket)`` with the manifest that holds and where it is from: flag, file, ticket, or none."""
    given = [(n, F.nullif(F.trim(F.coalesce(F.col(n), F.lit(""))), F.lit(""))) for n in ("flag", "file", "ticket")]
    source = F.coalesce(*[F.when(x.isNotNull(), F.lit(n)) for n, x in given], F.lit("none"))
    return tasks.select("change_id", F.coalesce(*[x for _, x in given]).alias("manifest"), source.alias("manifest_source"))


def manifest_states(changes: DataFrame, manifests: DataFrame, errors: DataFrame) -> DataFrame:
    """``change_id, id, found, error``: a change's manifest, whether there is one, and why it can't be read."""
    own = manifests.select("change_id", "id", F.lit(True).alias("_found")).join(errors.select("change_id", "error"), "change_id", "left")
    return changes.select("change_id").join(own, "change_id", "left").select("change_id", "id", F.coalesce("_found", F.lit(False)).alias("found"), "error")
