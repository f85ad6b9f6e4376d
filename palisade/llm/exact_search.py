"""Exact top-k search by integer inner product: norm-sorted vectors, rotated partial sums, residual bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.vectors import dealt, matrix, ranked, usable

FOUND = "query_id long, vec_id long, score long"
#: Rows, and queries, that are bounded at a time.
CHUNK, ASKED = 1024, 4096
#: Products below this are summed as 64-bit integers, others as Python's.
LIMIT = 2**62
#: Vectors with components from here on are outliers: no bound is made of them, they are scored one by one as Python's integers.
WIDE = 2.0**40
LEAST, MOST = -(2**63), 2**63 - 1


def rotation(rows: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the right singular vectors of the matrix of all vectors, strongest first.

    The Gram matrix is summed on the executors; d * d sums a length reach the driver.
    """

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                if dim:
                    x = matrix(part["v"], float)
                    x = x[np.abs(x).max(axis=1) < WIDE]
                    total[dim] = total.get(dim, 0) + x.T @ x
        for dim, g in total.items():
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"dim": dim, "i": i.ravel(), "j": j.ravel(), "x": g.ravel()})

    gram = rows.select("v").mapInPandas(sums, "dim int, i int, j int, x double").groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for dim, part in gram.groupby("dim"):
        g = np.zeros((dim, dim))
        g[part["i"], part["j"]] = part["x"]
        out[int(dim)] = np.linalg.eigh(g)[1][:, ::-1]
    return out


def products(x: np.ndarray, query: np.ndarray, wide: bool = False) -> np.ndarray:
    """Exact inner products of integers, also such that are kept as doubles. Those that don't fit 64 bits are Python's with ``wide``, else an error."""
    if x.size == 0 or x.shape[1] * float(np.abs(x).max()) * float(np.abs(query).max()) < LIMIT:
        return (x.astype(np.int64) * query.astype(np.int64)).sum(axis=1)
    whole = lambda a: np.frompyfunc(int, 1, 1)(a)
    exact = (whole(x) * whole(query)).sum(axis=1)
    if wide:
        return exact
    if max(map(abs, exact)) >= 2**63:
        raise OverflowError("an inner product leaves the range of a long")
    return exact.astype(np.int64)


def best_of(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        top = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], names[i]))[:k], int)
    else:
        top = np.lexsort((names, -scores))[:k]
    return scores[top], names[top]


def search_group(rows: pd.DataFrame, queries: pd.DataFrame, basis: np.ndarray | None, k: int) -> pd.DataFrame:
    """The best ``k`` rows of one stripe for each query of one block.

    Rows are taken in chunks by descending length. A chunk is skipped for a query once the product
    of lengths is below its k-th score; then the first half of the rotated components and the
    Cauchy-Schwarz bound on the rest decide which rows are scored exactly.
    """
    x, q = matrix(rows["v"], float), matrix(queries["v"], float)
    ids, q_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)

    def meet(n: int, some: np.ndarray) -> None:
        """Scores the rows at ``some`` for query ``n``."""
        some = some[ids[some] != q_ids[n]]
        if len(some):
            best[n] = best_of(np.concatenate([best[n][0], products(x[some], q[n], wide=True)]), np.concatenate([best[n][1], ids[some]]), k)
            if len(best[n][0]) == k:
                floor[n] = float(max(min(best[n][0][-1], 2**1000), -(2**1000)))

    far, q_far = np.abs(x).max(axis=1, initial=0) >= WIDE, np.abs(q).max(axis=1, initial=0) >= WIDE
    for n in range(len(q_ids)):
        meet(n, np.arange(len(ids)) if q_far[n] else np.flatnonzero(far))
    asked, plain = np.flatnonzero(~q_far), np.flatnonzero(~far)
    xf, qf = x[plain], q[asked]
    if basis is not None:
        xf, qf = xf @ basis, qf @ basis
    norms, q_norms = np.linalg.norm(xf, axis=1), np.linalg.norm(qf, axis=1)
    order = np.lexsort((ids[plain], -norms))
    plain, xf, norms = plain[order], xf[order], norms[order]
    half = x.shape[1] // 2
    rest, q_rest = np.linalg.norm(xf[:, half:], axis=1), np.linalg.norm(qf[:, half:], axis=1)
    slack = 1e-6 * (1 + norms[:1].max(initial=0) * q_norms)
    for at in range(0, len(plain), CHUNK):
        own = slice(at, at + CHUNK)
        live = np.flatnonzero(q_norms * norms[at] + slack >= floor[asked])
        if not len(live):
            break
        for some_live in np.array_split(live, -(-len(live) // ASKED)):
            bound = qf[some_live, :half] @ xf[own, :half].T + np.outer(q_rest[some_live], rest[own]) + slack[some_live, None]
            for row, n in zip(bound >= floor[asked[some_live], None], asked[some_live], strict=True):
                if row.any():
                    meet(n, plain[own][row])
    if any(s > MOST for scores, _ in best for s in scores[:1]):
        raise OverflowError("a score leaves the range of a long")
    # What is below all longs is only told from others if it comes to be returned.
    score = np.concatenate([np.empty(0, np.int64), *(np.array([max(s, LEAST) for s in scores], np.int64) if scores.dtype == object else scores for scores, _ in best)])
    return pd.DataFrame({"query_id": np.repeat(q_ids, [len(s) for s, _ in best]), "vec_id": np.concatenate([np.empty(0, np.int64), *(i for _, i in best)]), "score": score})


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, stripe_rows: int = 16384, block_rows: int = 32768) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` rows of highest integer inner product.

    ``rows`` and ``queries`` have ``vec_id`` and ``embedding``; each component x becomes
    floor(scale * x), whatever its size. A score that leaves the range of a long is an error if it is to be returned, never another value. Ties go to the smaller id. Vectors
    that are null or hold null or non-finite components, and null ids, take no part; only vectors of one
    length are compared (empty ones score 0). Rows with the query's id are its own and no candidates;
    repeated rows rank one by one, a repeated query is asked once. Empty tables give no rows. Other
    columns are ignored.
    """
    # Integers as doubles; from 2**53 on a double has no fraction.
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    ints = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    usual = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
    rows, queries = usual(rows), usual(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    bases = rotation(rows)
    keys = ["dim", "stripe", "block"]
    left, right = dealt(rows, queries, stripe_rows, block_rows)

    def group(key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_group(own, asked, bases.get(int(key[0])), k)

    found = ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, FOUND), k)
    low = F.raise_error(F.lit("a score leaves the range of a long")).cast("long")
    return found.withColumn("score", F.when(F.col("score") == LEAST, low).otherwise(F.col("score")))
