"""Detection, repair and reporting of anomalous values.

``keys=None`` treats the frame as one population in a global row order, ``keys=[...]``
treats every series on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast import DATE, KEYS, TARGET
from retailcast.operators.forest import IsolationForest
from retailcast.operators.ordered import interpolated, ordered_scan
from retailcast.operators.panel import series_window
from retailcast.operators.quantiles import global_quantiles, series_quantiles

STRATEGIES = ("interpolate", "cap", "remove")
CAP_MULTIPLIER = 1.5
REPORT_SCHEMA = (
    "date string, store_nbr int, family string, original_value double, "
    "method string, action string, new_value double"
)


def _with_fences(df: DataFrame, target: str, multiplier: float, keys: Sequence[str] | None) -> DataFrame:
    """Add ``_low`` and ``_high``, the bounds around the quartiles."""
    if keys:
        q = series_quantiles(target, (0.25, 0.75)).over(Window.partitionBy(*keys))
    else:
        q = global_quantiles(df, target, (0.25, 0.75)).scalar()
    q1, q3 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    spread = (q3 - q1) * F.lit(float(multiplier))
    return df.withColumn("_q", q).withColumns({"_low": q1 - spread, "_high": q3 + spread}).drop("_q")


def detect_iqr(
    df: DataFrame, target: str = TARGET, multiplier: float = 1.5, keys: Sequence[str] | None = None
) -> DataFrame:
    """Add ``anomaly_iqr``: strictly outside the fences; never for null."""
    bounded = _with_fences(df, target, multiplier, keys)
    x = F.col(target)
    outside = F.coalesce((x < F.col("_low")) | (x > F.col("_high")), F.lit(False))
    return bounded.withColumn("anomaly_iqr", outside).drop("_low", "_high")


def detect_anomalies(
    df: DataFrame,
    target: str = TARGET,
    multivariate_features: Sequence[str] | None = None,
    multiplier: float = 1.5,
    contamination: float = 0.01,
    keys: Sequence[str] | None = None,
    row_key: Sequence[str] = (DATE, *KEYS),
) -> DataFrame:
    """Add ``anomaly_iqr``, ``anomaly_if`` (false without features) and ``is_anomaly``."""
    flagged = detect_iqr(df, target, multiplier, keys)
    if multivariate_features:
        forest = IsolationForest(contamination=contamination).fit(df, multivariate_features, row_key)
        flagged = forest.flag(flagged)
    else:
        flagged = flagged.withColumn("anomaly_if", F.lit(False))
    return flagged.withColumn("is_anomaly", F.col("anomaly_iqr") | F.col("anomaly_if"))


def _interpolate(
    df: DataFrame, value: str, keys: Sequence[str] | None, date: str, order_by: Sequence[str]
) -> DataFrame:
    """Replace the null values of a column along the row order."""
    if not keys:
        scanned = ordered_scan(df, order_by, value)
        return scanned.withColumn(value, interpolated(value)).drop("pos", "prev", "next")
    forward = series_window(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    backward = series_window(keys, F.col(date).desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col(value).alias("val")))
    return (
        df.withColumn("_pos", F.row_number().over(series_window(keys, date)))
        .withColumn("_prev", F.last(own, ignorenulls=True).over(forward))
        .withColumn("_next", F.last(own, ignorenulls=True).over(backward))
        .withColumn(value, interpolated(value, "_prev", "_next", "_pos"))
        .drop("_pos", "_prev", "_next")
    )


def interpolate_nulls(
    df: DataFrame,
    value: str = TARGET,
    keys: Sequence[str] | None = KEYS,
    date: str = DATE,
    order_by: Sequence[str] = (DATE, *KEYS),
) -> DataFrame:
    """Linear interpolation of nulls, then the nearest known value at the ends."""
    return _interpolate(df, value, keys, date, order_by)


def _repair(
    df: DataFrame,
    strategy: str,
    target: str,
    keys: Sequence[str] | None,
    date: str,
    order_by: Sequence[str],
) -> DataFrame:
    """All rows with ``_new``, the value after handling (null where the row is removed)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    kept = F.when(~F.col("is_anomaly"), F.col(target).cast("double"))
    if strategy == "remove":
        return df.withColumn("_new", kept)
    if strategy == "interpolate":
        return _interpolate(df.withColumn("_new", kept), "_new", keys, date, order_by)
    bounded = _with_fences(df, target, CAP_MULTIPLIER, keys)
    clipped = F.when(F.col(target).isNotNull(), F.least(F.greatest(F.col(target), F.col("_low")), F.col("_high")))
    return bounded.withColumn("_new", clipped).drop("_low", "_high")


def handle_anomalies(
    df: DataFrame,
    strategy: str,
    target: str = TARGET,
    keys: Sequence[str] | None = None,
    date: str = DATE,
    order_by: Sequence[str] = (DATE, *KEYS),
) -> DataFrame:
    """The frame after handling.

    ``interpolate`` fills flagged values and values that were null before; ``cap``
    clips all rows to fences of 1.5 spreads whatever the detector used; ``remove``
    drops the flagged rows.
    """
    if strategy == "remove":
        return df.where(~F.col("is_anomaly"))
    done = _repair(df, strategy, target, keys, date, order_by)
    return done.withColumn(target, F.col("_new")).drop("_new").select(*df.columns)


def anomaly_records(
    df: DataFrame,
    strategy: str,
    target: str = TARGET,
    keys: Sequence[str] | None = None,
    date: str = DATE,
    order_by: Sequence[str] = (DATE, *KEYS),
) -> DataFrame:
    """One record per flagged row: value before and after, detector and action."""
    done = _repair(df, strategy, target, keys, date, order_by).where("is_anomaly")
    method = F.when(F.col("anomaly_iqr"), F.lit("iqr")).otherwise(F.lit("isolation_forest"))
    return done.select(
        F.col(date).cast("string").alias("date"),
        F.col("store_nbr").cast("int").alias("store_nbr"),
        F.col("family").cast("string").alias("family"),
        F.col(target).cast("double").alias("original_value"),
        method.alias("method"),
        F.lit(strategy).alias("action"),
        F.col("_new").cast("double").alias("new_value"),
    )


def anomaly_counts(records: DataFrame) -> DataFrame:
    """Total and count by detector, one row."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("method") == "iqr").alias("iqr"),
        F.count_if(F.col("method") == "isolation_forest").alias("isolation_forest"),
    )
