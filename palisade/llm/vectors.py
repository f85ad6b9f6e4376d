"""What the two searches share: usable vectors, and rows dealt into stripes and query blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def dealt(rows: DataFrame, queries: DataFrame, stripe_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both frames ``(vec_id, v)`` with ``dim, stripe, block``: each pair of a query and a row of one length meets in one group.

    Stripes and blocks have bounded sizes, so a group fits a task at any input size. A row is sent once for each block of queries,
    a query once for each stripe, so blocks are as large as a task's memory bears, not as small as one product of matrices.
    """
    stripes = max(1, -(-rows.count() // stripe_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("v").alias("dim")
    rows = rows.select("vec_id", "v", dim, part(stripes, 1).alias("stripe"), every(blocks).alias("block"))
    return rows, queries.select("vec_id", "v", dim, every(stripes).alias("stripe"), part(blocks, 2).alias("block"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query by score, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column, dtype) -> np.ndarray:
    return np.array([np.asarray(x, dtype) for x in column], dtype).reshape(len(column), -1)
