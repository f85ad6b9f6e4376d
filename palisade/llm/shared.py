"""What several operators share: tables in the cluster's shared folder, links and components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a folder made for it.
    """
    context = spark.sparkContext
    if folder := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
    return context.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` from the shared folder, once all that is made from them is written itself."""
    for df in tables:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written by now: it does so once the driver has collected what refers to them, which else comes late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written meanwhile hands its Python functions so many rows at a time: for rows of megabytes, of which a batch is held by the executor and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Characters that are laid out at a time, about; a longer text is laid out whole.
LAID = 300_000
#: Links that a task looks at together, about.
PART = 1_000_000


def chunks(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of ``LAID`` characters, about, each with the place of its first; nulls are empty."""
    own, size, at = [], 0, 0
    for x in texts:
        own.append(x or "")
        size += len(own[-1]) + 1
        if size >= LAID:
            yield at, own
            at, own, size = at + len(own), [], 0
    if own:
        yield at, own


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``flat[starts[i]:starts[i + 1]]`` of each i in ``which``, end to end."""
    sizes = starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + sizes, sizes)]


def joined_up(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest place that each of ``size`` places is linked to, over any number of links ``(i, j)``."""
    label = np.arange(size)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        for side in (i, j):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect just what ``links`` connects: in each part of about ``PART`` links, one at most for each id.

    So a group of k ids with links by the square of k goes on with about k of them. A part's ids are what a task holds.
    """

    def trees(batches):
        own: list[np.ndarray] = []
        n, most = 0, 2 * PART

        def flush() -> np.ndarray:
            ids, place = np.unique(np.concatenate(own), return_inverse=True)
            i, j = place.reshape(-1, 2).T
            label = joined_up(i, j, len(ids))
            some = np.flatnonzero(label != np.arange(len(ids)))
            return np.stack([ids[label[some]], ids[some]], axis=1).ravel()

        for batch in batches:
            own.append(batch[["a", "b"]].to_numpy(np.int64).ravel())
            n += len(batch)
            if n > most:
                own = [flush()]
                n = len(own[0]) // 2
                most = 2 * max(n, PART)
        if own:
            a, b = flush().reshape(-1, 2).T
            yield pd.DataFrame({"a": a, "b": b})

    return links.coalesce(max(1, links.count() // PART)).mapInPandas(trees, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``; component is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a minimum per
    node and a join, so a node with many links is split by the skew join, never gathered.
    """
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    edges = written(links.where("a <> b").select(*pair).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "links")
        removed(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def grouped_links(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    admissible: Callable[[str, str], Column],
    heads: DataFrame | None = None,
    rounds: int = 2,
    detail: Callable[[DataFrame], DataFrame] | None = None,
    close: Callable[[str, str], Column] | None = None,
    lead: str = "id",
) -> DataFrame:
    """Links ``(a, b)`` that connect just what all verified pairs would connect.

    ``postings(g, id, ...)``: ids that share a ``g`` are candidates. ``verify`` keeps the pairs
    ``(a, b)`` that are links; ``admissible(left, right)`` is a cheap condition on the two postings
    without which a pair cannot be one. Each round pairs the members of a group with one leader
    only; a group whose members are then connected is done, since a further link inside it would
    connect nothing new. Of the groups left, exactly the pairs across components are verified, the
    largest component's members never among themselves. So a group of near copies costs a
    multiple of its size, not its square, and no link between components is lost. ``heads(id, head)``
    lists the groups of an id in one order for all: a pair is then looked at in its first common group only,
    which must be the one where ``admissible`` holds if it does in any. Without it the order is that of ``g``.
    ``detail(ids)`` gives further columns by ``id`` for the pairs across components, and ``close(left, right)``
    is a condition on them, or on the postings, without which such a pair isn't looked at. The first leader of a group is its
    member with the least ``lead``.
    """
    found = None
    tried = None
    labels = None
    looked: list[DataFrame] = []
    for n in range(rounds + 1):
        own = postings if labels is None else postings.join(labels, "id", "left")
        own = own.withColumn("c", F.coalesce("c", "id") if labels is not None else F.col("id"))
        if n < rounds:
            pick = F.struct(F.xxhash64("c", F.lit(n)) if n else F.col(lead), F.col("id"))
        else:
            sizes = own.groupBy("g", "c").agg(F.count("*").alias("size"))
            main = sizes.groupBy("g").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("k")).where("k > 1")
        if n < rounds:
            lead = own.groupBy("g").agg(
                F.min_by(F.struct(*[x for x in own.columns if x != "g"]), pick).alias("r"),
                F.min("c").alias("c0"),
                F.max("c").alias("c1"),
            ).where("c0 <> c1").select("g", "r")
            pairs = own.join(lead, "g").select(F.struct(*[x for x in own.columns if x != "g"]).alias("l"), "r")
        else:
            open_ = own.join(main.select("g", "main"), "g")
            own_heads = open_.groupBy("id").agg(F.sort_array(F.collect_set("g")).alias("head")) if heads is None else heads
            open_ = open_.join(own_heads, "id")
            if detail is not None:
                open_ = open_.join(detail(open_.select("id").distinct()), "id")
            members = F.struct(*[x for x in open_.columns if x not in ("g", "main")])
            left = open_.where("c <> main").select("g", members.alias("l"))
            right = open_.select("g", members.alias("r"))
            pairs = left.join(right, "g").select("g", "l", "r")
        apart = (F.col("l.c") != F.col("r.c")) & admissible("l", "r")
        if n == rounds:
            # The cheap conditions come first.
            apart = apart if close is None else apart & close("l", "r")
            apart = apart & (F.get(F.array_intersect("l.head", "r.head"), F.lit(0)) == F.col("g"))
        pairs = pairs.where(apart)
        pairs = pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        looked.append(pairs)
        links = written(verify(pairs).select("a", "b"), "links")
        before, found = found, written(forest(links if found is None else found.unionByName(links)), "forest")
        removed(*(x for x in (links, before, labels) if x is not None))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if n < rounds:
            labels = near_labels(found)
    removed(*looked)
    return found


def near_labels(links: DataFrame) -> DataFrame:
    """``(id, c)``: ids with one ``c`` are connected by ``links``; two hops only, so not every connected pair has one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hop = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    far = hop.select(F.col("a").alias("m"), F.col("m").alias("mm"))
    return written(hop.join(far, "m").select(F.col("a").alias("id"), F.col("mm").alias("c")), "labels")
