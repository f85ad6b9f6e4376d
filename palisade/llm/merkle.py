"""Merkle manifest of a dataset: position trees by group, stored in bands of levels, and octopus multiproofs of leaf partitions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.shared import removed, written

#: Levels of a band: a group of 2**BAND nodes becomes one node of the next band.
BAND = 10
#: The tree over all groups' roots; groups' own names begin with another sign.
TOP = ""
NODE = "tree string, level int, place long, hash string"


def encoded(column: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns, one after the other as :func:`encoded`."""
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def tree_name(group: Column) -> Column:
    """A group's name: null first, then the groups' own bytewise order."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def joint(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


@dataclass
class Manifest:
    """``leaves(tree, place, hash, ...)``; ``bands[i]``: inner nodes of levels ``i * BAND + 1 .. (i + 1) * BAND``; ``roots(tree, place, hash)``: the groups'
    roots and their places below the top; ``sizes(tree, n)``, the top's included; ``root``: a row with the dataset's root, none for no rows."""

    leaves: DataFrame
    bands: list[DataFrame]
    roots: DataFrame
    sizes: DataFrame
    root: DataFrame


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows(tree, ...)`` written in order of ``tree, *order``, with each one's ``place`` in its tree.

    A range partitioning deals rows out, so a tree with most rows is many tasks' work; only counts by task and tree meet in a window.
    """
    kept = written(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    runs = kept.groupBy("tree", part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    runs = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy("tree").orderBy("_part")) - F.col("_n"))
    own = kept.withColumn("_part", part).join(runs, ["tree", "_part"])
    out = written(own.select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias("place")), "placed")
    removed(kept)
    return out


def folded(level: list[str], up: int, total: int) -> list[list[str]]:
    """The levels above ``level``, ``up`` at most, while the whole tree has ``total`` > 1 nodes."""
    out = []
    while up and total > 1:
        level = [joint(level[i : i + 2]) for i in range(0, len(level), 2)]
        out.append(level)
        up, total = up - 1, -(-total // 2)
    return out


def banded(nodes: DataFrame, sizes: DataFrame, base: int) -> DataFrame:
    """Inner nodes above ``nodes(tree, place, hash)`` of level ``base``, ``BAND`` levels at most: each group of 2**BAND neighbours by itself."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        rows = []
        for n, level in enumerate(folded(group["hash"].tolist(), BAND, int(group["n"].iloc[0])), 1):
            first = int(key[1]) << (BAND - n)
            rows += [(key[0], base + n, first + i, h) for i, h in enumerate(level)]
        return pd.DataFrame(rows, columns=["tree", "level", "place", "hash"])

    own = nodes.join(sizes.select("tree", "n"), "tree").withColumn("n", F.ceil(F.col("n") / (1 << base)))
    own = own.where("n > 1").withColumn("_block", F.shiftright("place", BAND))
    return own.select("tree", "place", "hash", "n", "_block").groupBy("tree", "_block").applyInPandas(build, NODE)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.length(F.bin(n - 1)) - F.when(n == 1, 1).otherwise(0)


def raised(nodes: DataFrame, sizes: DataFrame, known: int) -> list[DataFrame]:
    """All bands above the leaves ``nodes(tree, place, hash)``; ``known``: leaves of the largest tree."""
    bands, base = [], 0
    while -(-known // (1 << base)) > 1:
        bands.append(written(banded(nodes, sizes, base), "band"))
        base += BAND
        nodes = bands[-1].where(F.col("level") == base).drop("level")
    return bands


def tops(leaves: DataFrame, bands: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """``(tree, hash)``: each tree's root; a lone leaf is its own."""
    nodes = leaves.select("tree", F.lit(0).alias("level"), "place", "hash")
    for band in bands:
        nodes = nodes.unionByName(band)
    nodes = nodes.where("place = 0")
    return nodes.join(sizes, "tree").where(F.col("level") == height(F.col("n"))).select("tree", "hash")


def build(leaves: DataFrame, *order: str) -> Manifest:
    """The manifest of ``leaves(tree, hash, ...)``: a tree for each ``tree`` over its leaves by ``order``, and one over the trees' roots by name.

    While a level has more than one node, each two neighbours become one; a last node without a neighbour becomes one by itself.
    Further columns stay with the leaves. Equal rows in ``order`` stand next to each other by hash. No leaves, no root.
    """
    kept = placed(leaves, *order, "hash")
    sizes = written(kept.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    bands = raised(kept.select("tree", "place", "hash"), sizes, sizes.agg(F.max("n")).first()[0] or 0)
    names = tops(kept.select("tree", "place", "hash"), bands, sizes)
    # The trees' names are the order below the top: the same ranking, in a tree of its own.
    roots = placed(names.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "hash"), "name")
    over = roots.groupBy("tree").agg(F.count("*").alias("n"))
    above = raised(roots.select("tree", "place", "hash"), over, sizes.count())
    root = tops(roots.select("tree", "place", "hash"), above, over).select("hash")
    joined = [a.unionByName(b) if a is not None and b is not None else a if b is None else b for a, b in ((bands[i] if i < len(bands) else None, above[i] if i < len(above) else None) for i in range(max(len(bands), len(above))))]
    return Manifest(kept, joined, roots.select(F.col("name").alias("tree"), "place", "hash"), sizes.unionByName(over.select("tree", "n")), root)


def missing(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Octopus: ``(level, place)`` of the nodes that, with the leaves at ``places``, suffice for the root of ``n`` leaves; no fewer do.

    Level by level, a known node's neighbour is fetched unless it is known as well; then all their parents are known.
    """
    out, level, known = [], 0, np.unique(places)
    while n > 1:
        other = known ^ 1
        out += [(level, int(x)) for x in other[(other < n) & ~np.isin(other, known)]]
        known, n, level = np.unique(known >> 1), -(-n // 2), level + 1
    return out


def siblings(place: int, n: int, nodes: dict[tuple[int, int], str]) -> list[tuple[int, str | None]]:
    """``(side, hash)`` by level up to the root of ``n`` leaves: side 0 stands left of the path, 1 right, None is no neighbour."""
    out, level = [], 0
    while n > 1:
        other = place ^ 1
        out.append((other & 1, nodes[level, other] if other < n else None))
        place, n, level = place >> 1, -(-n // 2), level + 1
    return out


def climb(hash_: str, path: list[tuple[int, str | None]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for side, other in path:
        hash_ = joint([hash_] if other is None else [hash_, other] if side else [other, hash_])
    return hash_


def interiors(nodes: dict[tuple[int, int], str], n: int) -> dict[tuple[int, int], str]:
    """``nodes`` and all that follows from them: a parent of known nodes is known."""
    level = 0
    own = {p: h for (at, p), h in nodes.items() if at == 0}
    out = dict(nodes)
    while n > 1:
        up = {}
        for p in {x >> 1 for x in own}:
            pair = [own.get(2 * p), own.get(2 * p + 1)]
            if pair[0] is not None and (pair[1] is not None or 2 * p + 1 >= n):
                up[p] = joint([x for x in pair if x is not None])
        level, n = level + 1, -(-n // 2)
        own = up | {p: h for (at, p), h in nodes.items() if at == level}
        out |= {(level, p): h for p, h in own.items()}
    return out


PROOF = "proof string, proof_sha256 string, folded_root string, subroot string, root string"


def prove(manifest: Manifest, wanted: Column | None = None, claimed: str = "hash", with_path: bool = True) -> DataFrame:
    """The leaves that ``wanted`` holds for (all, if None), with ``proof, proof_sha256, folded_root, subroot, root``.

    A leaf partition is the wanted part of 2**BAND neighbours of a tree. It names the nodes that it lacks, gets each of them once, whatever
    the number of its leaves, derives the nodes between, and writes its leaves' proofs: siblings from the leaf to the tree's root, then to the
    dataset's, comma-joined with their side ahead (``<`` left, ``>`` right); left out with ``with_path=False``. ``proof_sha256`` is the hash of the
    siblings in a row. ``folded_root`` is where the leaf's column ``claimed`` and the proof lead.
    """
    leaves = manifest.leaves if wanted is None else manifest.leaves.where(wanted)
    trees = manifest.roots.select("tree", F.col("place").alias("_top"), F.col("hash").alias("subroot")).join(manifest.sizes.select("tree", "n"), "tree")
    whole = manifest.sizes.where(F.col("tree") == TOP).select(F.col("n").alias("_trees"))
    count = whole.first()
    count = int(count[0]) if count else 0
    parts = leaves.withColumn("_block", F.shiftright("place", BAND))
    own = parts.groupBy("tree", "_block").agg(F.sort_array(F.collect_set("place")).alias("places")).join(trees, "tree")

    def name(batches):
        for batch in batches:
            rows = []
            for tree, block, places, top, n in zip(batch["tree"], batch["_block"], batch["places"], batch["_top"], batch["n"], strict=True):
                rows += [(tree, block, tree, *x) for x in missing(np.asarray(places, np.int64), int(n))]
                rows += [(tree, block, TOP, *x) for x in missing(np.array([top], np.int64), count)]
            yield pd.DataFrame(rows, columns=["of", "block", "tree", "level", "place"])

    lacking = own.select("tree", "_block", "places", "_top", "n").mapInPandas(name, "of string, block long, tree string, level int, place long")
    # Only the bands that are asked for are read: whole neighbourhoods ask for none of the lowest.
    lacking = written(lacking, "lacking")
    bands = {r[0] for r in lacking.select(F.when(F.col("level") == 0, -1).otherwise(F.expr(f"(level - 1) div {BAND}")).alias("b")).distinct().collect()}
    nodes = manifest.roots.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), "place", "hash")
    if -1 in bands:
        nodes = nodes.unionByName(manifest.leaves.select("tree", F.lit(0).alias("level"), "place", "hash"))
    for n in sorted(bands - {-1}):
        nodes = nodes.unionByName(manifest.bands[n])
    fetched = lacking.join(nodes, ["tree", "level", "place"]).select("of", "block", "tree", "level", "place", "hash")
    fields = [f"{n} {t}" for n, t in leaves.dtypes if n not in ("tree", "place")]
    kept = [n for n, _ in leaves.dtypes if n not in ("tree", "place")]

    def expand(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*kept, "proof", "proof_sha256", "folded_root", "subroot", "root"])
        n, top = int(rows["n"].iloc[0]), int(rows["_top"].iloc[0])
        below = {(int(a), int(p)): h for t, a, p, h in zip(got["tree"], got["level"], got["place"], got["hash"], strict=True) if t != TOP}
        above = {(int(a), int(p)): h for t, a, p, h in zip(got["tree"], got["level"], got["place"], got["hash"], strict=True) if t == TOP}
        below = interiors(below | {(0, int(p)): h for p, h in zip(rows["place"], rows["hash"], strict=True)}, n)
        over = siblings(top, count, above)
        subroot = below[n_levels(n), 0]
        root = climb(subroot, over)
        proofs, sums, ends = [], [], []
        for place, said in zip(rows["place"], rows[claimed], strict=True):
            path = siblings(int(place), n, below) + over
            proofs.append(",".join("<>"[s] + h for s, h in path if h is not None) if with_path else None)
            sums.append(joint([h for _, h in path if h is not None]))
            ends.append(climb(said, path))
        return rows[kept].assign(proof=proofs, proof_sha256=sums, folded_root=ends, subroot=subroot, root=root)

    sides = parts.join(trees.drop("subroot"), "tree").select("tree", "_block", "place", *kept, "_top", "n")
    out = sides.groupBy("tree", "_block").cogroup(fetched.groupBy("of", "block")).applyInPandas(expand, ", ".join([*fields, PROOF]))
    return out if with_path else out.drop("proof")


def n_levels(n: int) -> int:
    return (n - 1).bit_length()


def manifest_of(documents: DataFrame, columns: tuple[str, ...], group: str, key: str, changes: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``documents``: leaves over ``columns``, a tree for each value of ``group``, leaves by ``key`` (null first, ties by their hashes).

    ``changes`` gives columns other values; the leaf of the row so changed is kept as ``claimed``. A null value hashes as ``-``, a null group is a tree of its own, before
    all others; repeated rows are leaves of their own; other columns are ignored. Texts are hashed where they are read and never shuffled.
    """
    changed = [(changes or {}).get(c, F.col(c)) for c in columns]
    leaves = documents.select(F.col(key).alias("key"), tree_name(F.col(group)).alias("tree"), leaf(*map(F.col, columns)).alias("hash"), leaf(*changed).alias("claimed"))
    return build(leaves, "key")


def verified(documents: DataFrame, columns: tuple[str, ...], group: str, key: str, changes: dict[str, Column] | None = None) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``documents``: whether the row, after ``changes``, is the manifest's.

    See :func:`manifest_of` for nulls, repeated rows and other columns; no rows give no rows.
    """
    found = prove(manifest_of(documents, columns, group, key, changes), claimed="claimed", with_path=False)
    return found.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
