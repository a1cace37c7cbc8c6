"""The canonical panel: one row per series and day.

Everything that works on a whole series (windows, grouped functions) takes a
panel. At daily grain a series cannot hold more rows than the calendar has days,
so no task ever receives an unbounded group, however skewed the raw rows are.
``daily_panel`` brings raw rows to that grain with map-side sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from retailcast import DATE, KEYS, TARGET


def series_window(keys: Sequence[str] = KEYS, order_by: str | Column = DATE) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order_by)


def daily_panel(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    measures: Sequence[str] = (TARGET,),
) -> DataFrame:
    """Sum measures to one row per series and day; a sum over nothing is 0."""
    sums = [F.coalesce(F.sum(m), F.lit(0).cast(df.schema[m].dataType)).alias(m) for m in measures]
    return df.groupBy(*keys, date).agg(*sums)


def daily_total(df: DataFrame, date: str = DATE, target: str = TARGET) -> DataFrame:
    """Total of all series per day."""
    return daily_panel(df, (), date, (target,))


def require_daily_grain(df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Fail at run time when a series has two rows for a day. Rows with a null key belong to no series and pass.

    The check shares the exchange and sort of the series window that follows it.
    """
    same_day = F.lag(date).over(series_window(keys, date)).eqNullSafe(F.col(date))
    first = F.row_number().over(series_window(keys, date)) == 1
    message = F.concat(F.lit("more than one row of a series on "), F.col(date).cast("string"))
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    ok = F.when(same_day & ~first & named, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_unique", ok).where("_unique").drop("_unique")


def known_series(keys: Sequence[str]) -> Column:
    """True when no key of the row is null."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def global_span(df: DataFrame, date: str = DATE) -> Column:
    """First and last date of the frame as one scalar struct (lo, hi)."""
    return df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("span")).scalar()


def densify(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    values: Sequence[str] = (TARGET,),
    fill: str | None = "ffill",
    span: str = "series",
) -> DataFrame:
    """Reindex every series to a daily calendar.

    Each row is exploded over the gap that follows it, so the calendar costs one
    window on the series and no join. ``fill`` is ``ffill``, ``zero`` or None;
    ``span`` is the range of the series or of the whole frame (``global``).
    """
    if fill not in ("ffill", "zero", None):
        raise ValueError(f"unknown fill: {fill}")
    if span not in ("series", "global"):
        raise ValueError(f"unknown span: {span}")
    w = series_window(keys, date)
    following = F.lead(date).over(w)
    tie = F.raise_error(F.lit("more than one row of a series on a day")).cast("date")
    stop = F.when(following <= F.col(date), tie).otherwise(F.date_sub(following, 1))
    start = F.col(date)
    if span == "global":
        ends = global_span(df, date)
        stop = F.coalesce(stop, ends["hi"])
        start = F.when(F.lag(date).over(w).isNull(), ends["lo"]).otherwise(start)
    else:
        stop = F.coalesce(stop, F.col(date))
    carried = [
        F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if fill == "ffill" else F.col(v)
        for v in values
    ]
    gaps = df.where(F.col(date).isNotNull()).select(
        *keys,
        F.col(date).alias("_own"),
        start.alias("_start"),
        stop.alias("_stop"),
        *[c.alias(v) for c, v in zip(carried, values, strict=True)],
    )
    days = gaps.withColumn(date, F.explode(F.sequence("_start", "_stop")))
    out = []
    for v in values:
        kept = F.when(F.col(date) >= F.col("_own") if fill == "ffill" else F.col(date) == F.col("_own"), F.col(v))
        out.append((F.coalesce(kept, F.lit(0)) if fill == "zero" else kept).alias(v))
    return days.select(*keys, date, *out)


def series_split(
    df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE, train_share: float = 0.8
) -> DataFrame:
    """Flag the first ``floor(n * share)`` rows of each series as ``is_train``."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    position = F.row_number().over(series_window(keys, date))
    return df.withColumn("is_train", position <= F.floor(size * F.lit(train_share)))


def min_group_size(df: DataFrame, keys: Sequence[str] = KEYS, min_rows: int = 100) -> DataFrame:
    """Keep the rows of series with at least ``min_rows`` rows."""
    sized = df.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return sized.where(F.col("_size") >= min_rows).drop("_size")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Place rows by key over at least twice the cluster's cores.

    Adaptive execution merges partitions by their bytes; groups of few bytes but much
    computing would all end in one task. A stated number of partitions is left alone.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, 2 * spark.sparkContext.defaultParallelism), *by)


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """The last ``n`` rows of each series."""
    back = F.row_number().over(series_window(keys, F.col(date).desc()))
    return df.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def last_values(
    df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE, target: str = TARGET
) -> DataFrame:
    """Last date and the value on it, per series."""
    return df.groupBy(*keys).agg(F.max(date).alias(date), F.max_by(target, date).alias(target))


def future_calendar(
    df: DataFrame, horizon: int, keys: Sequence[str] = KEYS, date: str = DATE
) -> DataFrame:
    """The ``horizon`` days after the last date of each series."""
    ends = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    days = F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))
    return ends.where(F.col("_last").isNotNull()).select(*keys, F.explode(days).alias(date))


def top_series(
    df: DataFrame,
    within: Sequence[str] = ("store_nbr",),
    item: str = "family",
    target: str = TARGET,
) -> DataFrame:
    """The item with the largest total in each group; the first in name order on ties."""
    totals = df.groupBy(*within, item).agg(F.coalesce(F.sum(target), F.lit(0.0)).alias("total"))
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.col("total").desc(), item))
    return totals.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct values of a key, sorted."""
    return df.select(key).distinct().orderBy(key)


def filter_rows(df: DataFrame, between: tuple | None = None, date: str = DATE, **equals) -> DataFrame:
    """Equality filters plus a closed date range; ``None``/"All" or an absent column means no filter."""
    out = df
    for column, value in equals.items():
        if value is None or value == "All" or column not in df.columns:
            continue
        many = isinstance(value, (list, tuple, set))
        out = out.where(F.col(column).isin(*value) if many else F.col(column) == F.lit(value))
    if between is not None and date in df.columns:
        out = out.where(F.col(date).between(*[F.lit(b).cast("date") for b in between]))
    return out
