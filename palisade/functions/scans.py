"""Running values over ordered groups of any length, in two levels: within blocks, then over the blocks, so that one group is many tasks' work."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How values of rows, and then of whole blocks, come together; ``last`` passes over nulls.
JOINED = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def running(rows: DataFrame, keys: list[str], order: str, block: Column, **values: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``values``: name = (``sum``, ``max`` or ``last``, of what), over all rows of ``keys`` up to this one in ``order``.

    ``block`` must not fall as ``order`` rises; its size bounds what one task sorts. Only one row a block meets in a group of ``keys``. Null keys are keys as well.
    """
    # As a struct, keys are compared with their nulls, so the join below finds rows sorted as the window left them.
    within = Window.partitionBy("_keys", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"_keys": F.struct(*keys), "_block": block})
    own = own.withColumns({n: JOINED[kind](c).over(within) for n, (kind, c) in values.items()})
    ends = own.groupBy("_keys", "_block").agg(F.max_by(F.struct(*values), order).alias("_end"))
    before = Window.partitionBy("_keys").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_keys", "_block", *[JOINED[kind](F.col(f"_end.{n}")).over(before).alias(f"_c_{n}") for n, (kind, _) in values.items()])
    # Most groups are one block, to which nothing is carried.
    carried = carried.where(reduce(or_, (F.col(f"_c_{n}").isNotNull() for n in values)))
    both = own.join(carried, ["_keys", "_block"], "left")
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    out = {n: join[kind](F.col(f"_c_{n}"), F.col(n)) for n, (kind, _) in values.items()}
    return both.withColumns(out).select(*rows.columns, *values)
