"""Report queries over sales, backtest reports and anomaly records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast import DATE, KEYS, TARGET
from retailcast.functions.metrics import METRICS
from retailcast.operators.backtest import model_names
from retailcast.operators.panel import filter_rows
from retailcast.operators.quantiles import global_quantiles

Z95 = 1.96


def naive_band(
    df: DataFrame,
    horizon: int = 28,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
) -> DataFrame:
    """Last value carried forward with a band of 1.96 sample deviations, for every series."""
    ends = df.groupBy(*keys).agg(
        F.max(date).alias("_last"),
        F.max_by(target, date).alias("prediction"),
        F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("_std"),
    )
    days = F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))
    width = F.lit(Z95) * F.col("_std")
    return ends.where(F.col("_last").isNotNull()).select(
        *keys,
        F.explode(days).alias(date),
        "prediction",
        (F.col("prediction") - width).alias("lower"),
        (F.col("prediction") + width).alias("upper"),
    )


def model_comparison(report: DataFrame, metrics: Sequence[str] = METRICS, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each error per model (and series with ``keys``), with a flag at the smallest of each column."""
    present = [m for m in metrics if m in report.columns]
    means = report.groupBy(*keys, "model").agg(*[F.avg(m).alias(m) for m in present])
    # one row per model
    whole = Window.partitionBy(*keys)
    return means.withColumns({f"best_{m}": F.col(m) == F.min(m).over(whole) for m in present})


def error_histogram(report: DataFrame, metric: str = "rmse", bins: int = 30) -> DataFrame:
    """Counts per model in equal bins over the range of the error."""
    span = report.agg(F.struct(F.min(metric).alias("lo"), F.max(metric).alias("hi")).alias("s")).scalar()
    known = report.where(F.col(metric).isNotNull()).withColumns({"_lo": span["lo"], "_hi": span["hi"]})
    place = F.floor(F.try_divide((F.col(metric) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    # the largest value closes the last bin
    bucket = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))
    return known.groupBy("model", bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def error_box(report: DataFrame, metric: str = "rmse", models: Sequence[str] | None = None) -> DataFrame:
    """Quartiles and whiskers (the last points within 1.5 spreads) per model.

    A report by series has a row per series and window, so the quartiles are taken by
    the distributed method, once per model.
    """
    names = models if models is not None else model_names(report)
    known = report.where(F.col(metric).isNotNull())
    boxes = []
    for name in names:
        own = known.where(F.col("model") == name)
        q = global_quantiles(own, metric, (0.25, 0.5, 0.75)).scalar()
        q1, q3 = F.get("_q", F.lit(0)), F.get("_q", F.lit(2))
        reach = (q3 - q1) * 1.5
        x = F.col(metric)
        boxes.append(
            own.withColumn("_q", q)
            .withColumns({"_low": q1 - reach, "_high": q3 + reach})
            .groupBy("model")
            .agg(
                F.min(F.when(x >= F.col("_low"), x)).alias("whisker_low"),
                F.first(q1).alias("q1"),
                F.first(F.get("_q", F.lit(1))).alias("median"),
                F.first(q3).alias("q3"),
                F.max(F.when(x <= F.col("_high"), x)).alias("whisker_high"),
            )
        )
    if not boxes:
        columns = ("whisker_low", "q1", "median", "q3", "whisker_high")
        return known.select("model", *[F.col(metric).alias(c) for c in columns])
    return reduce(DataFrame.unionByName, boxes)


def report_keys(report: DataFrame, keys: Sequence[str] | None) -> list[str]:
    """The series keys given, or those that the report has."""
    return [k for k in KEYS if k in report.columns] if keys is None else list(keys)


def metric_over_windows(report: DataFrame, metric: str = "mape", keys: Sequence[str] | None = None) -> DataFrame:
    """The error of each model along the test periods of each series."""
    keys = report_keys(report, keys)
    return report.select(*keys, "model", "test_start", metric).orderBy(*keys, "model", "test_start")


def windows_won(report: DataFrame, metric: str = "mape", keys: Sequence[str] | None = None) -> DataFrame:
    """Number of windows (of each series) in which each model has the smallest error; ties go by model
    name, and a model without a score wins nothing."""
    keys = report_keys(report, keys)
    best = report.where(F.col(metric).isNotNull()).groupBy(*keys, "window_id").agg(
        F.min_by("model", F.struct(metric, "model")).alias("model")
    )
    won = best.groupBy("model").agg(F.count(F.lit(1)).alias("windows_won"))
    return won.orderBy(F.col("windows_won").desc(), "model")


def metric_summary(report: DataFrame, metrics: Sequence[str] = METRICS, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of each error per model (and series with ``keys``)."""
    aggs = []
    for m in metrics:
        if m in report.columns:
            aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return report.groupBy(*keys, "model").agg(*aggs)


REPORT_COLUMNS = ("date", "store_nbr", "family", "original_value", "method", "action", "new_value")


def anomaly_details(records: DataFrame, store=None, family=None, method=None) -> DataFrame:
    """Records that pass the filters, the latest first."""
    kept = filter_rows(records, store_nbr=store, family=family, method=method)
    kept = kept.select(*[c for c in REPORT_COLUMNS if c in kept.columns])
    return kept.orderBy(F.col("date").desc()) if "date" in kept.columns else kept


def anomaly_rollup(records: DataFrame) -> DataFrame:
    """Record counts by store, family and method with all subtotals of that order."""
    return records.rollup("store_nbr", "family", "method").agg(F.count(F.lit(1)).alias("n"))
