"""Joins of the sales rows with their lookup tables.

A lookup of free size carries no broadcast hint: Catalyst broadcasts it while its measured
size is under the session's threshold and falls back to a shuffled join, with adaptive
skew splitting, beyond it. Only tables reduced to one row per date are broadcast outright,
as the calendar bounds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_by(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per key; fails at run time when a key occurs twice.

    The grouping leaves the rows placed by the join key, so the join that follows
    needs no further exchange of this side.
    """
    rest = [c for c in df.columns if c not in on]
    grouped = df.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in rest]
    )
    message = F.concat_ws(" ", F.lit("duplicate lookup key:"), *[F.col(c).cast("string") for c in on])
    ok = F.when(F.col("_copies") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return grouped.where(ok).select(*df.columns)


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    duplicates: str = "error",
    null_safe: bool = False,
) -> DataFrame:
    """Left join that keeps every row of ``fact``.

    ``duplicates="error"`` guarantees the row count; ``"multiply"`` lets repeated
    lookup keys repeat rows. ``null_safe`` matches null keys with null keys.
    Columns present on both sides get the suffixes ``_x`` and ``_y``.
    """
    if duplicates not in ("error", "multiply"):
        raise ValueError(f"unknown duplicates rule: {duplicates}")
    on = [on] if isinstance(on, str) else list(on)
    shared = [c for c in lookup.columns if c in fact.columns and c not in on]
    left = fact.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = lookup if duplicates == "multiply" else unique_by(lookup, on)
    right = right.withColumnsRenamed({c: f"{c}_y" for c in shared})
    if not null_safe:
        return left.join(right, on, "left")
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    matched = F.lit(True)
    for c in on:
        matched = matched & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(right, matched, "left").drop(*[f"_right_{c}" for c in on])


def join_per_date(fact: DataFrame, per_date: DataFrame, date: str = "date") -> DataFrame:
    """Left join with a table grouped by date, without shuffling the fact rows.

    A century has 36,525 dates and the date type itself 3.7 million, so the broadcast side
    stays small whatever the size of the data.
    """
    return fact.join(F.broadcast(per_date), date, "left")


def merge_sources(
    sales: DataFrame,
    stores: DataFrame | None = None,
    oil: DataFrame | None = None,
    transactions: DataFrame | None = None,
    duplicates: str = "error",
    null_safe: bool = False,
) -> DataFrame:
    """Sales with store attributes, oil price and transaction counts, each where given."""
    out = sales
    for lookup, on in ((stores, ["store_nbr"]), (oil, ["date"]), (transactions, ["date", "store_nbr"])):
        if lookup is not None:
            out = lookup_join(out, lookup, on, duplicates, null_safe)
    return out
