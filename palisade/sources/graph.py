"""Commit graphs: chains of first parents, corrected dates, and what is reachable from some commits but not from others.

A graph is cut into chains, paths along first parents, in which every commit has a place. Of a chain, what a commit reaches is always all up to some place,
so sets of commits are a few places, and walks go from chain to chain, not from commit to commit: they take as many rounds as there are forks on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.scans import running
from palisade.sources.tables import settled

#: Places of a chain that are joined by one key; ranges are cut there.
STEP = 1000


@dataclass(frozen=True)
class Graph:
    """``places(commit, chain, place, n_parents)``; ``crossings(chain, place, to_chain, to_place)``: parents in other chains."""

    places: DataFrame
    crossings: DataFrame


def chained(commits: DataFrame, parents: DataFrame) -> Graph:
    """The graph of ``commits(commit)`` and ``parents(child, parent, ord)``; ``ord`` 0 is the first parent. Parents that are no commits, as beyond a shallow copy's rim, are none.

    A chain goes on from a commit to the one of its first children with the smallest id. Places come from doubling steps along the chains, so their number is the
    logarithm of the longest; a row leaves the rounds once it knows its chain.
    """
    commits = commits.select("commit").distinct()
    known = parents.join(commits.select(F.col("commit").alias("parent")), "parent", "left_semi").join(commits.select(F.col("commit").alias("child")), "child", "left_semi")
    known = settled(known.select("child", "parent", "ord").distinct(), "parents")
    heirs = known.where("ord = 0").groupBy("parent").agg(F.min("child").alias("child"))
    step = settled(commits.join(heirs.select(F.col("child").alias("commit"), "parent"), "commit", "left"), "steps")
    done = step.where("parent is null").select("commit", F.col("commit").alias("chain"), F.lit(0).cast("long").alias("place"))
    going = step.where("parent is not null").select("commit", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far"))
    while not going.isEmpty():
        ends = done.select(F.col("commit").alias("up"), "chain", F.col("place").alias("_place"))
        arrived = going.join(ends, "up").select("commit", "chain", (F.col("far") + F.col("_place")).alias("place"))
        # No two rows have one ``up``, so no key of this join is hot.
        beyond = going.select(F.col("commit").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        going = settled(going.join(beyond, "up").select("commit", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far")), "going")
        done = settled(done.unionByName(arrived), "chains")
    count = known.groupBy(F.col("child").alias("commit")).agg(F.count("*").alias("n_parents"))
    places = settled(done.join(count, "commit", "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0))), "places")
    ends = places.select(F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    crossings = known.join(places.withColumnRenamed("commit", "child"), "child").join(ends, "parent").where("chain <> to_chain")
    return Graph(places, settled(crossings.select("chain", "place", "to_chain", "to_place"), "crossings"))


def stepped(low: Column, high: Column) -> Column:
    """The steps of places above ``low``, up to ``high``."""
    return F.explode(F.sequence(F.floor((low + 1) / STEP), F.floor(high / STEP)))


def reach(graph: Graph, tips: DataFrame, beyond: DataFrame | None = None, over: str | None = None) -> DataFrame:
    """``(key, chain, low, top)``: from ``tips(key, commit)`` all places above ``low`` and up to ``top`` of a chain are reachable.

    Without ``beyond`` all ``low`` are -1. ``beyond(over, chain, top)`` bounds the walk: what is reachable there isn't walked, nor returned; ``over`` is then a column of ``tips`` too.
    """
    extra = [over] if over else []
    cross = graph.crossings.withColumn("_step", F.floor(F.col("place") / STEP))
    wall = None if beyond is None else beyond.select(over, "chain", F.col("top").alias("_wall"))

    def bounded(rows: DataFrame) -> DataFrame:
        if wall is None:
            return rows
        return rows.join(wall, [over, "chain"], "left").withColumn("low", F.greatest("low", F.coalesce("_wall", F.lit(-1)))).drop("_wall").where("top > low")

    start = tips.join(graph.places.select("commit", "chain", "place"), "commit").groupBy("key", *extra, "chain").agg(F.max("place").alias("top"))
    front = settled(bounded(start.withColumn("low", F.lit(-1).cast("long"))), "front")
    found = front
    while not front.isEmpty():
        legs = front.withColumn("_step", stepped(F.col("low"), F.col("top"))).join(cross, ["chain", "_step"]).where("place > low and place <= top")
        new = legs.groupBy("key", *extra, F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("top"))
        known = found.groupBy("key", "chain").agg(F.max("top").alias("_top"))
        new = new.join(known, ["key", "chain"], "left").withColumn("low", F.coalesce("_top", F.lit(-1).cast("long"))).where("top > low")
        front = settled(bounded(new.select("key", *extra, "chain", "top", "low")), "front")
        found = found.unionByName(front)
    return found.groupBy("key", *extra, "chain").agg(F.min("low").alias("low"), F.max("top").alias("top"))


def commits_of(graph: Graph, ranges: DataFrame) -> DataFrame:
    """``key, commit, n_parents`` of ``ranges(key, chain, low, top)``."""
    places = graph.places.withColumn("_step", F.floor(F.col("place") / STEP))
    legs = ranges.select("key", "chain", "low", "top", stepped(F.col("low"), F.col("top")).alias("_step"))
    return legs.join(places, ["chain", "_step"]).where("place > low and place <= top").select("key", "commit", "n_parents")


def corrected(graph: Graph, dates: DataFrame) -> DataFrame:
    """``(commit, at)``: dates that rise from parents to children: a commit's own in ``dates(commit, at)``, or one more than its latest parent's.

    Within chains that is a running maximum; rounds go on only while a crossing lifts a commit, so clocks that are right cost one.
    """
    rows = settled(graph.places.join(dates.select("commit", "at"), "commit").select("commit", "chain", "place", F.col("at").cast("long").alias("at")), "dates")
    lifted = None
    while True:
        own = rows if lifted is None else rows.join(lifted, ["chain", "place"], "left").withColumn("at", F.greatest("at", F.coalesce("_lift", "at"))).drop("_lift")
        ran = running(own, ["chain"], "place", F.floor(F.col("place") / STEP), _most=("max", F.col("at") - F.col("place")))
        value = settled(ran.select("commit", "chain", "place", (F.col("_most") + F.col("place")).alias("value")), "corrected")
        above = value.select(F.col("chain").alias("to_chain"), F.col("place").alias("to_place"), (F.col("value") + 1).alias("_lift"))
        lifts = graph.crossings.join(above, ["to_chain", "to_place"]).groupBy("chain", "place").agg(F.max("_lift").alias("_lift"))
        new = lifts.join(value.select("chain", "place", "value"), ["chain", "place"]).where("_lift > value").select("chain", "place", "_lift")
        new = settled(new if lifted is None else new.unionByName(lifted.withColumn("_old", F.lit(True)), allowMissingColumns=True), "lifts")
        if (new if lifted is None else new.where("_old is null")).isEmpty():
            return value.select("commit", F.col("value").alias("at"))
        lifted = new.groupBy("chain", "place").agg(F.max("_lift").alias("_lift"))


def numbered(listed: DataFrame, dates: DataFrame, block_seconds: int = 86_400) -> DataFrame:
    """``key, ordinal, commit``: oldest first from 1 by ``dates(commit, at)``, ties by id; parents come before children if the dates are :func:`corrected`.

    A list of any length is ranked in blocks of time, not in one window.
    """
    rows = listed.join(dates, "commit").withColumn("_order", F.struct("at", "commit"))
    out = running(rows, ["key"], "_order", F.floor(F.col("at") / block_seconds), ordinal=("sum", F.lit(1)))
    return out.select("key", F.col("ordinal").cast("long").alias("ordinal"), "commit")


def rev_list(graph: Graph, wants: DataFrame, unwanted: DataFrame, dates: DataFrame, merges: bool = False) -> DataFrame:
    """``key, ordinal, commit``: for each list ``key`` of ``wants(key, over, commit)`` the commits reachable from its own, less those reachable from
    ``unwanted(over, commit)``; oldest first, merges left out unless asked for.

    ``A..B`` wants B and leaves out A; all lists of one ``over`` share what is left out, as new branches share a repository's remote ones: it is walked
    once, and bounds their walks, so a list costs what is new in it. A list whose commits are unknown, or all left out, has no rows.
    """
    out = reach(graph, unwanted.select(F.col("over").alias("key"), "commit"))
    wall = settled(out.select(F.col("key").alias("over"), "chain", "top"), "wall")
    found = commits_of(graph, reach(graph, wants.select("key", "over", "commit"), wall, "over"))
    return numbered(found if merges else found.where("n_parents < 2"), dates)
