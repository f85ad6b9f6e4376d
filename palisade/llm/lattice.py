"""Near-duplicate embeddings: random projections decoded to E8 lattice points in several tables, neighbouring cells probed, cosines verified."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.shared import components, forest, joined_up, removed, written
from palisade.llm.vectors import usable

#: Members of a cell that one side of a tile has, about; larger cells are split.
TILE = 256
#: Cell width by the distance of unit vectors at the least cosine: both of a pair so far apart keep cells in common (see ``linked``).
WIDTH = 5.0
#: The shortest vectors of the E8 lattice, a point's 240 nearest neighbours.
NEAREST = np.array(
    [[s * (n == i) + t * (n == j) for n in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    + [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer components of an even sum."""
    near = np.rint(x)
    gap = x - near
    rows = np.arange(len(x))
    worst = np.abs(gap).argmax(axis=1)
    odd = near.sum(axis=1) % 2 != 0
    near[rows[odd], worst[odd]] += np.where(gap[rows, worst] >= 0, 1, -1)[odd]
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice points: E8 is D8 and D8 shifted by a half in each component."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def mixed(points: np.ndarray, seed: int) -> np.ndarray:
    """64-bit names of lattice points."""
    out = np.full(points.shape[:-1], np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64), np.uint64)
    for n in range(points.shape[-1]):
        out = (out ^ (2 * points[..., n]).astype(np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Tables:
    """The cells of unit vectors: in each table a home and its ``probes`` nearest neighbours by distance from the projected point."""

    def __init__(self, least: float, tables: int, probes: int, lattices: int, seed: int):
        self.width, self.tables, self.probes, self.lattices, self.seed = WIDTH * math.sqrt(max(2 - 2 * least, 1e-12)), tables, probes, lattices, seed
        self.projections: dict[int, np.ndarray] = {}

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """``[vector, table, cell]`` names, the home first, the table in the last eight bits. The sums don't depend on what else is in ``unit``: a vector has the same cells in every task."""
        dim = unit.shape[1]
        if dim not in self.projections:
            self.projections[dim] = np.random.default_rng(self.seed).standard_normal((self.tables * self.lattices, dim, 8)) / self.width
        out = []
        for t in range(self.tables):
            names = np.zeros((len(unit), 1), np.int64)
            for b in range(self.lattices):
                x = np.einsum("nd,de->ne", unit, self.projections[dim][t * self.lattices + b])
                home = nearest_e8(x)
                by = np.argsort(-np.einsum("ne,ve->nv", x - home, NEAREST), axis=1, kind="stable")[:, : self.probes]
                own = np.concatenate([home[:, None], home[:, None] + NEAREST[by]], axis=1)
                with np.errstate(over="ignore"):
                    names = (names[:, :, None] * 1_000_003 + mixed(own, t * self.lattices + b)[:, None]).reshape(len(unit), -1)
            out.append((names << 8) | t)
        return np.stack(out, axis=1)


def unit_rows(packed: pd.Series) -> np.ndarray:
    """Vectors of one length in double precision, each divided by its length; scaled first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def pack(batches):
    """Column ``v`` of doubles as bytes; the other columns pass untouched."""
    for batch in batches:
        n = batch.schema.get_field_index("v")
        v = batch.column(n)
        at = (np.asarray(v.offsets) * 8).astype(np.int32)
        valid = pa.array(np.asarray(v.is_valid())).buffers()[1]
        data = np.asarray(v.values.fill_null(0.0), "<f8").tobytes()
        yield batch.set_column(n, "v", pa.Array.from_buffers(pa.binary(), len(v), [valid, pa.py_buffer(at.tobytes()), pa.py_buffer(data)]))


def linked(rows: DataFrame, least: float, tables: int, probes: int, lattices: int, seed: int, tile: int) -> DataFrame:
    """``(a, b, n)``: for each class of ``rows(cls, label, v, size)`` rows of ``b`` null whose ``n`` add up to the vectors linked with it from other classes,
    and links ``(a, b)`` between classes that connect what all links connect.

    A pair is a candidate if one's home is among the other's cells in some table; it is examined in every cell where that is so,
    and counted in the first. Members of a cell meet in tiles of bounded size; within one nothing is written for a pair.
    """
    coder = Tables(least, tables, probes, lattices, seed)

    def dealt(batches):
        for batch in batches:
            for _, part in batch.groupby(batch["v"].map(len), sort=False):
                cells = coder.cells(unit_rows(part["v"]))
                _, t, k = cells.shape
                yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(), t * k), "label": np.repeat(part["label"].to_numpy(), t * k), "dim": np.repeat(part["v"].map(len).to_numpy(), t * k), "cell": cells.ravel(), "home": np.tile(np.arange(k) == 0, len(part) * t)})

    kind = dict(rows.dtypes)["label"]
    members = written(rows.select("cls", "label", "v").mapInPandas(dealt, f"cls long, label {kind}, dim int, cell long, home boolean"), "cells")
    # Most cells have nothing to compare: they go before a vector is moved.
    key = ["label", "dim", "cell"]
    sizes = members.groupBy(*key).agg(F.count_if("home").alias("h"), F.count("*").alias("m")).where("h > 0 and m > 1").drop("h")
    q = F.ceil(F.col("m") / tile).cast("int")
    own = members.join(sizes, key).withColumn("q", q).withColumn("s", F.pmod(F.xxhash64("cls", "cell"), F.col("q")).cast("int"))
    # A tile (i, j) holds homes of part i, and homes of part j >= i and guests of part j.
    every = lambda f: F.transform(F.sequence(F.lit(0), F.col("q") - 1), f)
    first = every(lambda x: F.struct(F.col("s").alias("i"), x.alias("j"), F.lit(0).alias("role")))
    second = every(lambda x: F.struct(x.alias("i"), F.col("s").alias("j"), F.lit(1).alias("role")))
    second = F.filter(second, lambda x: ~F.col("home") | (x["i"] <= x["j"]))
    roles = F.when(F.col("home"), F.concat(first, second)).otherwise(second)
    own = own.select("cls", *key, "home", F.explode(roles).alias("r")).select("cls", *key, "home", "r.*")
    own = own.join(rows.select("cls", "v", "size"), "cls")
    at = [*key, "i", "j"]
    own = own.repartition(*at).sortWithinPartitions(*at)

    def meet(x: np.ndarray, g: dict[str, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """What one tile of unit vectors ``x`` finds: ``(a, b, n)`` as in the result, ``b`` -1 for null."""
        left, right = np.flatnonzero(g["role"] == 0), np.flatnonzero(g["role"])
        if not len(left) or not len(right):
            return []
        a, b = np.nonzero(x[left] @ x[right].T >= least - 1e-9)
        a, b = left[a], right[b]
        cls, guest = g["cls"], ~g["home"][b]
        # Two homes of one part meet twice in its own tile.
        some = (cls[a] != cls[b]) & (guest | (g["i"][0] != g["j"][0]) | (cls[a] < cls[b]))
        a, b = a[some], b[some]
        a, b = (side[np.einsum("nd,nd->n", x[a], x[b]) >= least] for side in (a, b))
        if not len(a):
            return []
        cell = int(g["cell"][0])
        t = cell & 255
        seen, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        cells = coder.cells(x[seen])
        p, q_ = cells[place[: len(a)]], cells[place[len(a) :]]
        met = (p[:, :, :1] == q_).any(axis=2) | (q_[:, :, :1] == p).any(axis=2)
        # An earlier table, or in this one the other's home, a smaller cell, where the left is a guest.
        again = met[:, :t].any(axis=1) | (~g["home"][b] & (q_[:, t, 0] < cell) & (p[:, t] == q_[:, t, :1]).any(axis=1))
        a, b = a[~again], b[~again]
        if not len(a):
            return []
        ids, place = np.unique(np.concatenate([cls[a], cls[b]]), return_inverse=True)
        i, j = place[: len(a)], place[len(a) :]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, i, g["size"][b])
        np.add.at(n, j, g["size"][a])
        label = joined_up(i, j, len(ids))
        far = np.flatnonzero(label != np.arange(len(ids)))
        return [(ids, np.full(len(ids), -1), n), (ids[label[far]], ids[far], np.zeros(len(far), np.int64))]

    def tiles(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            held = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if held is None or not len(held):
                continue
            starts = np.flatnonzero(~(held[at] == held[at].shift()).all(axis=1).to_numpy())
            # The last tile may go on in the next batch.
            ends, rest = (np.append(starts[1:], len(held)), None) if batch is None else (starts[1:], held.iloc[starts[-1] :])
            g = {c: held[c].to_numpy() for c in ("role", "home", "cls", "size", "i", "j", "cell", "dim")}
            place = np.zeros(len(held), np.int64)
            units = {}
            for dim in np.unique(g["dim"]):
                own = np.flatnonzero(g["dim"] == dim)
                place[own], units[dim] = np.arange(len(own)), unit_rows(held["v"].iloc[own])
            found = []
            for s, e in zip(starts, ends, strict=False):
                found += meet(units[g["dim"][s]][place[s] : place[s] + e - s], {c: x[s:e] for c, x in g.items()})
            if found:
                a, b, n = map(np.concatenate, zip(*found, strict=True))
                yield pd.DataFrame({"a": a, "b": pd.arrays.IntegerArray(b, b < 0), "n": n})

    out = written(own.select("cls", *at, "home", "role", "v", "size").mapInPandas(tiles, "a long, b long, n long"), "met")
    removed(members)
    return out


def near_duplicates(rows: DataFrame, least: float = 0.98, tables: int = 4, probes: int = 3, lattices: int = 1, seed: int = 7, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows(vec_id, embedding, label)``.

    Vectors are compared only with those of the same label and length, by cosine in double precision; those of ``least`` or more link. Pairs are found by
    cells of the E8 lattice in ``tables`` tables; none below ``least`` links, and of pairs at ``least`` 998 in 1000 are found with the
    values given here, nearer ones more often. The cells of ``lattices`` = 2 are so much smaller that a label of a thousand million vectors has few in one;
    it takes about ten tables. ``n_links``: other rows linked directly; ``component_id``: the smallest id reachable, ``kept`` marks it.
    Equal vectors are one class, compared once and counted as many. Rows without label, without vector, with zero vectors or with null
    or non-finite components link with nothing and are components of themselves; of null ids ``component_id`` is null and ``kept`` false, and they take no part.
    Repeated rows are vectors of their own that share an id: each counts the others. Other columns are ignored; no rows give no rows.
    """
    usual = usable(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(usual, F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    plain = written(plain.mapInArrow(pack, f"vec_id long, label {dict(plain.dtypes)['label']}, v binary"), "vectors")
    whole = plain.where("v is not null")
    classes = whole.groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    met = linked(classes.select("cls", "label", "v", "size"), least, tables, probes, lattices, seed, tile)
    links = written(forest(met.where("b is not null").select("a", "b")), "forest")
    joined = written(components(links).select(F.col("id").alias("cls"), "component"), "components")
    degree = met.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("more"))
    own = classes.select("cls", "label", "v", "least_id", "size").join(degree, "cls", "left").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    roots = own.groupBy("component").agg(F.min("least_id").alias("component_id"))
    own = own.join(roots, "component").select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = plain.join(own, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
