"""Approximate nearest neighbours by inner product: stable projections in a kd-tree, chi-square stopping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.vectors import dealt, matrix, ranked, usable

FOUND = "query_id long, vec_id long, score double"
#: Rows verified before the first test, and the room left for single precision.
FIRST, MARGIN = 256, 1e-5


def chi_square(x: float, m: int) -> float:
    """P(chi-square of ``m`` degrees <= x), for even ``m``."""
    half, term, total = x / 2, 1.0, 1.0
    if half > 700:
        return 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


class ProjectedTree:
    """A kd-tree over projected points; ``order`` lists the rows leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        groups = [np.arange(len(points))]
        while any(len(g) > leaf_rows for g in groups):
            split = []
            for g in groups:
                if len(g) <= leaf_rows:
                    split.append(g)
                    continue
                own = points[g]
                g = g[np.argsort(own[:, np.argmax(np.ptp(own, axis=0))], kind="stable")]
                split += [g[: len(g) // 2], g[len(g) // 2 :]]
            groups = split
        self.order = np.concatenate(groups)
        self.starts = np.cumsum([0, *map(len, groups)])
        self.low = np.array([points[g].min(axis=0) for g in groups])
        self.high = np.array([points[g].max(axis=0) for g in groups])

    def bounds(self, point: np.ndarray) -> np.ndarray:
        """The least squared projected distance of each leaf."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def chi_square_at(p: float, m: int) -> float:
    """The value that a chi-square of ``m`` degrees stays below with probability ``p``."""
    low, high = 0.0, 100.0 * m
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def search_group(rows: pd.DataFrame, queries: pd.DataFrame, k: int, dims: int, confidence: float, leaf_rows: int, seed: int) -> pd.DataFrame:
    """The nearest rows of one stripe found for each query of one block.

    Largest inner product is least distance once a component makes all rows equally long. Rows are
    verified by growing projected distance, in batches; leaves and rows are passed over once a nearer row
    would have so large a projected distance with less than ``1 - confidence`` probability. Batches are
    compared in single precision with a margin; the scores of what is kept are exact.
    """
    x, q = matrix(rows["v"], float), matrix(queries["v"], float)
    ids, q_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    squares = (x * x).sum(axis=1)
    top = squares.max(initial=0)
    project = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, dims))
    points = np.column_stack([x, np.sqrt(np.maximum(top - squares, 0))]) @ project
    tree = ProjectedTree(points, leaf_rows)
    x, ids, points = x[tree.order], ids[tree.order], points[tree.order]
    asked, ratio = q @ project[:-1], chi_square_at(confidence, dims)
    scale = max(top**0.5, 1e-300)
    single = (x / scale).astype(np.float32)
    sizes, lengths = np.diff(tree.starts), (points * points).sum(axis=1)
    out = []
    for n, own in enumerate(q):
        q_norm = max(float(own @ own) ** 0.5, 1e-300)
        near = (own / q_norm).astype(np.float32)
        bounds = tree.bounds(asked[n])
        first = np.argsort(bounds, kind="stable")[: max(1, -(-FIRST // leaf_rows))]
        todo = np.concatenate([np.arange(tree.starts[i], tree.starts[i + 1]) for i in first])
        done, cosines = np.empty(0, np.int64), np.empty(0, np.float32)
        far, size, rest = None, FIRST, None
        while len(todo):
            todo = todo[ids[todo] != q_ids[n]]
            done, cosines = np.concatenate([done, todo]), np.concatenate([cosines, single[todo] @ near])
            if len(done) > k:
                kth = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                some = cosines >= kth - MARGIN
                done, cosines = done[some], cosines[some]
                far = max(top + q_norm**2 - 2 * float(kth) * q_norm * scale, 0) + MARGIN * (top + q_norm**2)
            if rest is None:
                live = np.ones(len(bounds), bool) if far is None else bounds <= ratio * far
                live[first] = False
                rest = np.flatnonzero(np.repeat(live, sizes))
                gaps = lengths[rest] - 2 * (points[rest] @ asked[n]) + asked[n] @ asked[n]
            if far is not None:
                some = gaps <= ratio * far + MARGIN
                rest, gaps = rest[some], gaps[some]
            size *= 4
            if len(rest) > size:
                cut = np.argpartition(gaps, size)
                todo, rest, gaps = rest[cut[:size]], rest[cut[size:]], gaps[cut[size:]]
            else:
                todo, rest, gaps = rest, rest[:0], gaps[:0]
        scores, names = (x[done] * own).sum(axis=1), ids[done]
        best = np.lexsort((names, -scores))[:k]
        out.append((names[best], scores[best]))
    return pd.DataFrame({"query_id": np.repeat(q_ids, [len(s) for _, s in out]), "vec_id": np.concatenate([np.empty(0, np.int64), *(i for i, _ in out)]), "score": np.concatenate([np.empty(0), *(s for _, s in out)])})


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    dims: int = 16,
    confidence: float = 0.85,
    leaf_rows: int = 64,
    stripe_rows: int = 32768,
    block_rows: int = 16384,
    seed: int = 7,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query ``k`` rows of large inner product, in double precision.

    ``rows`` and ``queries`` have ``vec_id`` and ``embedding``. Each stripe of rows has a kd-tree over
    ``dims`` (even) Gaussian projections; nothing is fitted, every row is indexed. ``confidence`` bounds
    the chance with which the stopping test passes over a nearer row. Scores are exact; ties go to the
    smaller id. Vectors that are null, zero or empty or hold null or non-finite components, and null
    ids, take no part; only vectors of one length are compared. Rows with the query's id are its own;
    repeated rows rank one by one, a repeated query is asked once. Empty tables give no rows. Other
    columns are ignored.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    usual = lambda df: df.where(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v"))
    rows, queries = usual(rows), usual(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    keys = ["dim", "stripe", "block"]
    left, right = dealt(rows, queries, stripe_rows, block_rows)

    def group(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_group(own, asked, k, dims, confidence, leaf_rows, seed)

    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, FOUND), k)
