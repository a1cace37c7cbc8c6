"""Validation of a sales table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast import DATE, TARGET

# fixed values: texts of the warnings
GAPS = "Found %d missing dates in time series"
NULLS = "Found %d total missing values"
NEGATIVES = "Found %d rows with negative sales"


def calendar(df: DataFrame, date: str = DATE) -> DataFrame:
    """Every day between the first and the last date of the frame."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias(date))


def missing_dates(df: DataFrame, date: str = DATE) -> DataFrame:
    """Days of the calendar on which no row exists."""
    days = df.select(F.expr(f"try_cast(`{date}` AS date)").alias(date))
    return calendar(days, date).join(days.distinct(), date, "left_anti")


def _total(columns: Sequence[str]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out + F.col(c)
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls per column as a map, and their total."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = [p for c in df.columns for p in (F.lit(c), F.col(c))]
    return counted.select(F.create_map(*pairs).alias("missing_values_count"), _total(df.columns).alias("total_missing"))


def validate_sales_data(
    df: DataFrame, date: str = DATE, target: str = TARGET, keys: Sequence[str] = ()
) -> DataFrame:
    """Gaps in the dates, null counts, negative values and the warnings about them.

    One row, or one row per series with ``keys``. Nulls do not make a table invalid.
    The rows are reduced to one per date (and series) map-side, and what follows is
    bounded by the calendar.
    """
    day = F.expr(f"try_cast(`{date}` AS date)")
    nulls = {c: f"_null_{i}" for i, c in enumerate(df.columns)}
    per_day = df.groupBy(*keys, day.alias("_day")).agg(
        *[F.count_if(F.col(c).isNull()).alias(n) for c, n in nulls.items()],
        F.count_if(F.col(target) < 0).alias("_negative"),
    )
    whole = per_day.groupBy(*keys).agg(
        F.min("_day").alias("_lo"),
        F.max("_day").alias("_hi"),
        F.collect_set("_day").alias("_days"),
        *[F.sum(n).alias(n) for n in nulls.values()],
        F.sum("_negative").alias("negative_sales_count"),
    )
    if not keys:  # an empty table still gives one row
        whole = whole.fillna(0, [*nulls.values(), "negative_sales_count"])
    gaps = F.array_sort(F.array_except(F.sequence("_lo", "_hi"), "_days"))
    found = whole.withColumns(
        {
            "_gaps": F.coalesce(gaps, F.array().cast("array<date>")),
            "_total": _total(list(nulls.values())),
        }
    )
    n_gaps, negative, total = F.size("_gaps"), F.col("negative_sales_count"), F.col("_total")
    warnings = F.array_compact(
        F.array(
            F.when(n_gaps > 0, F.format_string(GAPS, n_gaps)),
            F.when(total > 0, F.format_string(NULLS, total)),
            F.when(negative > 0, F.format_string(NEGATIVES, negative)),
        )
    )
    pairs = [p for c, n in nulls.items() for p in (F.lit(c), F.col(n))]
    return found.select(
        *keys,
        ((n_gaps == 0) & (negative == 0)).alias("is_valid"),
        F.transform("_gaps", lambda d: d.cast("string")).alias("missing_dates"),
        F.create_map(*pairs).alias("missing_values_count"),
        "negative_sales_count",
        warnings.alias("warnings"),
    )
