"""Windows over a symbol's bars.

All use one partitioning and order, so Spark sorts a table once for any number of them.  Two rules
for missing values: *positional* functions look at the last n bars; *compacting* ones look at the
last n values that are there and keep their result on a bar without one.  Columns whose nulls
only lead (bar columns, results of other functions) need no compaction: ``dense=True``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered() -> WindowSpec:
    """A symbol's bars in order of time."""
    return Window.partitionBy("symbol").orderBy("time")


def running() -> WindowSpec:
    """All bars up to the current one."""
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def last(n: int) -> WindowSpec:
    """The last n bars, the current one included."""
    return ordered().rowsBetween(-(max(1, n) - 1), 0)


def bar_index(bars: DataFrame) -> DataFrame:
    """``bars`` with ``bar_index`` from 0 and whether a bar is the first or last of its symbol."""
    return bars.withColumns({"bar_index": (F.row_number().over(ordered()) - 1).cast("long"), "is_first": F.lag("time").over(ordered()).isNull(), "is_last": F.lead("time").over(ordered()).isNull()})


def history(x: Column, n: int) -> Column:
    """The value n bars ago."""
    return F.lag(x, n).over(ordered())


def rolling(bars: DataFrame, x: str, n: int, out: str, make: Callable[[Column, WindowSpec], Column], dense: bool = True, full: bool = True) -> DataFrame:
    """``make`` over the last n values of ``x``; null until there are n of them, unless not ``full``."""
    n = max(1, n)
    value = F.col(x)
    if dense:
        frame = last(n)
        return bars.withColumn(out, F.when(F.count(value).over(frame) == n, make(value, frame)) if full else make(value, frame))
    present = Window.partitionBy("symbol", value.isNotNull()).orderBy("time").rowsBetween(-(n - 1), 0)
    own = F.when(value.isNotNull() & (F.count(value).over(present) == n if full else F.lit(True)), make(value, present))
    return bars.withColumn("__own", own).withColumn(out, F.last("__own", ignorenulls=True).over(running())).drop("__own")


def compacting(bars: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` adds, worked out over the bars that have all of ``columns``; other bars keep the last of it.

    The bars with values are a partition of their own while ``make`` works, so its windows see
    them side by side, in the same single shuffle.
    """
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    keyed = bars.withColumns({"__symbol": F.col("symbol"), "__there": present}).withColumn("symbol", F.struct("symbol", "__there"))
    made = make(keyed)
    new = [c for c in made.columns if c not in keyed.columns]
    back = made.withColumn("symbol", F.col("__symbol")).withColumns({c: F.when(F.col("__there"), F.col(c)) for c in new})
    return back.withColumns({c: F.last(c, ignorenulls=True).over(running()) for c in new}).drop("__symbol", "__there")


def staged(bars: DataFrame, temporary: dict[str, Column], out: dict[str, Column]) -> DataFrame:
    """Columns that need other window columns below them; the temporary ones go again."""
    return bars.withColumns(temporary).withColumns(out).drop(*temporary)
