"""Position, previous and next known value in one global row order.

A running value over a whole table would be a window without partitions, that is
one task. Here the order columns form a hierarchy instead, for example
(date, store, family): rows are numbered inside (date, store), these groups inside
date, and only the dates - bounded by the calendar - are numbered in one partition.
Every level passes its carry down by an equi-join on its prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# columns of a segment: rows in it, first and last known (position, value) in it
_N, _FIRST, _LAST = "_n", "_first", "_last"
# what a segment receives: rows before it, nearest known values outside it
_OFF, _PREV, _NEXT = "_off", "_prev", "_next"


def _moved(entry: str, by: str) -> Column:
    e = F.col(entry)
    return F.when(e.isNotNull(), F.struct((e["pos"] + F.col(by)).alias("pos"), e["val"].alias("val")))


def _scan(segments: DataFrame, order_by: Sequence[str]) -> DataFrame:
    *prefix, leaf = order_by
    ahead = Window.partitionBy(*prefix).orderBy(leaf).rowsBetween(Window.unboundedPreceding, -1)
    # looking forward = looking back in descending order, which runs in linear time
    behind = Window.partitionBy(*prefix).orderBy(F.col(leaf).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = (
        segments.withColumn(_OFF, F.coalesce(F.sum(_N).over(ahead), F.lit(0)).cast("long"))
        .withColumn(_FIRST, _moved(_FIRST, _OFF))
        .withColumn(_LAST, _moved(_LAST, _OFF))
        .withColumn(_PREV, F.last(_LAST, ignorenulls=True).over(ahead))
        .withColumn(_NEXT, F.last(_FIRST, ignorenulls=True).over(behind))
    )
    if not prefix:
        return local
    groups = local.groupBy(*prefix).agg(
        F.sum(_N).cast("long").alias(_N), F.min(_FIRST).alias(_FIRST), F.max(_LAST).alias(_LAST)
    )
    outer = _scan(groups, prefix).select(
        *prefix, F.col(_OFF).alias("_o_off"), F.col(_PREV).alias("_o_prev"), F.col(_NEXT).alias("_o_next")
    )
    joined = local.join(outer, list(prefix))
    return joined.withColumns(
        {
            _OFF: F.col(_OFF) + F.col("_o_off"),
            _FIRST: _moved(_FIRST, "_o_off"),
            _LAST: _moved(_LAST, "_o_off"),
            _PREV: F.coalesce(_moved(_PREV, "_o_off"), F.col("_o_prev")),
            _NEXT: F.coalesce(_moved(_NEXT, "_o_off"), F.col("_o_next")),
        }
    ).drop("_o_off", "_o_prev", "_o_next")


def ordered_scan(df: DataFrame, order_by: Sequence[str], value: str) -> DataFrame:
    """Add ``pos`` (from 1), and ``prev`` / ``next``: the nearest known (pos, val) strictly
    before and after the row in the global order. ``order_by`` must identify a row and
    start with a column of few values, such as the date.
    """
    own = F.when(F.col(value).isNotNull(), F.struct(F.lit(1).cast("long").alias("pos"), F.col(value).alias("val")))
    segments = df.withColumns({_N: F.lit(1).cast("long"), _FIRST: own, _LAST: own})
    return (
        _scan(segments, list(order_by))
        .withColumns({"pos": F.col(_OFF) + 1, "prev": F.col(_PREV), "next": F.col(_NEXT)})
        .drop(_N, _FIRST, _LAST, _OFF, _PREV, _NEXT)
    )


def filled(value: str) -> Column:
    """Forward fill, on the output of ``ordered_scan`` for the same value."""
    return F.coalesce(F.col(value), F.col("prev")["val"])


def interpolated(value: str, prev: str = "prev", following: str = "next", pos: str = "pos") -> Column:
    """Linear between known neighbours; the nearest known value at the two ends."""
    p, n = F.col(prev), F.col(following)
    slope = F.try_divide((F.col(pos) - p["pos"]).cast("double"), (n["pos"] - p["pos"]).cast("double"))
    line = p["val"] + (n["val"] - p["val"]) * slope
    return F.coalesce(F.col(value), line, p["val"], n["val"])


def global_lag(numbered: DataFrame, column: str, by: int, alias: str) -> DataFrame:
    """The value ``by`` positions earlier in the global order, by an equi-join on ``pos``."""
    earlier = numbered.select((F.col("pos") + by).alias("pos"), F.col(column).alias(alias))
    return numbered.join(earlier, "pos", "left")
