"""Backtests over expanding (or rolling) time windows, for all series in one job.

Window k trains up to ``first + k * step`` and tests the days after it. Because the
windows are an arithmetic sequence, the ids a row belongs to follow from its date: rows
are exploded to their ids, and no range join or scan per window is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast import DATE, KEYS, TARGET
from retailcast.config import BacktestConfig
from retailcast.functions.metrics import METRICS, all_metrics, two_sided_p
from retailcast.operators.panel import global_span, require_daily_grain, series_window, spread

Model = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _first_train_end(lo: Column, cfg: BacktestConfig) -> Column:
    return F.add_months(lo, cfg.train_window_months)


def _last_id(lo: Column, hi: Column, cfg: BacktestConfig) -> Column:
    """Id of the last window; negative when the range holds none."""
    room = F.date_diff(hi, _first_train_end(lo, cfg)) - cfg.test_window_days
    return F.floor(room / F.lit(cfg.step_days)).cast("int")


def _window_dates(df: DataFrame, cfg: BacktestConfig, rolling: bool) -> DataFrame:
    """Attach the four dates to rows with ``window_id`` and the range ``_lo``."""
    train_end = F.date_add(_first_train_end(F.col("_lo"), cfg), F.col("window_id") * F.lit(cfg.step_days))
    start = F.date_add("_lo", F.col("window_id") * F.lit(cfg.step_days)) if rolling else F.col("_lo")
    return df.withColumns(
        {
            "train_start": start,
            "train_end": train_end,
            "test_start": F.date_add(train_end, 1),
            "test_end": F.date_add(train_end, cfg.test_window_days),
        }
    )


def backtest_windows(
    df: DataFrame,
    keys: Sequence[str] = (),
    date: str = DATE,
    cfg: BacktestConfig = BacktestConfig(),
    rolling: bool = False,
) -> DataFrame:
    """The windows of the whole frame, or of every series with ``keys``."""
    ranges = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    last = _last_id(F.col("_lo"), F.col("_hi"), cfg)
    ids = ranges.withColumn("_k", last).where(F.col("_k") >= 0)
    ids = ids.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    return _window_dates(ids, cfg, rolling).select(
        *keys, "window_id", "train_start", "train_end", "test_start", "test_end"
    )


def _with_range(df: DataFrame, keys: Sequence[str], date: str, span: str) -> DataFrame:
    if span == "global":
        ends = global_span(df, date)
        return df.withColumns({"_lo": ends["lo"], "_hi": ends["hi"]})
    if span != "series":
        raise ValueError(f"unknown span: {span}")
    w = Window.partitionBy(*keys)
    return df.withColumns({"_lo": F.min(date).over(w), "_hi": F.max(date).over(w)})


def _test_ids(date: str, cfg: BacktestConfig) -> Column:
    """Ids of the windows that test the row's date, as an array."""
    off = F.date_diff(F.col(date), _first_train_end(F.col("_lo"), cfg))
    low = F.greatest(F.ceil((off - cfg.test_window_days) / F.lit(cfg.step_days)), F.lit(0)).cast("int")
    high = F.least(F.floor((off - 1) / F.lit(cfg.step_days)), _last_id(F.col("_lo"), F.col("_hi"), cfg)).cast("int")
    return F.when(low <= high, F.sequence(low, high))


def tested_rows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    cfg: BacktestConfig = BacktestConfig(),
    span: str = "series",
    rolling: bool = False,
) -> DataFrame:
    """Rows of the test periods, one per (row, window), with the window's dates."""
    tagged = _with_range(df, keys, date, span).withColumn("window_id", F.explode(_test_ids(date, cfg)))
    return _window_dates(tagged, cfg, rolling).drop("_lo", "_hi")


def baseline_predictions(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    cfg: BacktestConfig = BacktestConfig(),
    span: str = "series",
    mean_rows: int = 28,
) -> DataFrame:
    """Predictions of the last-value and trailing-mean models in every window.

    The training statistics are running values of the series, read off at the last row of
    each training period and carried to the test rows of the same window. The training
    rows themselves are never repeated, and the series is shuffled once.
    """
    w = series_window(keys, date)
    grain = require_daily_grain(df.select(*keys, date, target), keys, date)
    ranged = _with_range(grain, keys, date, span)
    stats = F.struct(
        F.row_number().over(w).alias("n"),
        F.col(target).cast("double").alias("naive"),
        F.avg(target).over(w.rowsBetween(1 - mean_rows, 0)).alias("mean"),
    )
    first = _first_train_end(F.col("_lo"), cfg)
    last = _last_id(F.col("_lo"), F.col("_hi"), cfg)
    # windows whose training ends on this row: train_end in [date, next date - 1]
    following = F.lead(date).over(w)
    low = F.greatest(F.ceil(F.date_diff(F.col(date), first) / F.lit(cfg.step_days)), F.lit(0)).cast("int")
    upper = F.floor((F.date_diff(following, first) - 1) / F.lit(cfg.step_days)).cast("int")
    high = F.least(F.coalesce(upper, last), last)
    ends = F.when(low <= high, F.sequence(low, high))
    none = F.array().cast("array<int>")
    roles = F.concat(
        F.transform(F.coalesce(F.col("_ends"), none), lambda k: F.struct(k.alias("id"), F.lit(0).alias("role"))),
        F.transform(F.coalesce(F.col("_tests"), none), lambda k: F.struct(k.alias("id"), F.lit(1).alias("role"))),
    )
    exploded = (
        ranged.withColumns({"_stats": stats, "_ends": ends, "_tests": _test_ids(date, cfg)})
        .withColumn("_r", F.explode(roles))
        .withColumn("window_id", F.col("_r.id"))
    )
    # a window's training end precedes its test rows, and a day may play one role only
    in_window = Window.partitionBy(*keys, "window_id").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    trained = F.last(F.when(F.col("_r.role") == 0, F.col("_stats")), ignorenulls=True).over(in_window)
    scored = exploded.withColumn("_train", trained).where(
        (F.col("_r.role") == 1) & (F.col("_train.n") >= cfg.min_train_samples)
    )
    models = F.array(
        F.struct(F.lit("naive").alias("model"), F.col("_train.naive").alias("yhat")),
        F.struct(F.lit(f"mean_{mean_rows}d").alias("model"), F.col("_train.mean").alias("yhat")),
    )
    return scored.select(
        *keys, "window_id", date, F.col(target).cast("double").alias("y"), F.inline(models)
    ).select(*keys, "window_id", date, "model", "y", "yhat")


def model_predictions(
    df: DataFrame,
    models: Mapping[str, Model],
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    cfg: BacktestConfig = BacktestConfig(),
    span: str = "series",
    rolling: bool = False,
    windows_per_task: int = 32,
) -> DataFrame:
    """Predictions of user models ``f(train, test) -> 1-d array`` in every window.

    A task holds one series and a run of ``windows_per_task`` windows, so a series is
    repeated once per run, not once per window, and many windows of one series still
    spread over tasks. A model that fails gives rows with a null ``yhat`` and the text of
    the error; the other models and windows go on.
    """
    columns = df.columns
    grain = require_daily_grain(df, keys, date)
    ranged = _with_range(grain, keys, date, span)
    last = _last_id(F.col("_lo"), F.col("_hi"), cfg)
    off = F.date_diff(F.col(date), _first_train_end(F.col("_lo"), cfg))
    # the first window whose test period reaches the row
    from_id = F.greatest(F.ceil((off - cfg.test_window_days) / F.lit(cfg.step_days)), F.lit(0))
    runs = F.sequence(
        F.floor(from_id / F.lit(windows_per_task)).cast("int"),
        F.floor(F.col("_last") / F.lit(windows_per_task)).cast("int"),
    )
    placed = (
        ranged.withColumn("_last", last)
        .where((F.col("_last") >= 0) & (from_id <= F.col("_last")))
        .withColumn("_run", F.explode(runs))
        .withColumn("_first_end", _first_train_end(F.col("_lo"), cfg))
    )
    by = [df.schema[k] for k in keys]
    schema = T.StructType(
        [
            *by,
            T.StructField("window_id", T.IntegerType()),
            T.StructField(date, T.DateType()),
            T.StructField("model", T.StringType()),
            T.StructField("y", T.DoubleType()),
            T.StructField("yhat", T.DoubleType()),
            T.StructField("error", T.StringType()),
        ]
    )
    names = [f.name for f in schema]
    step, test_days, least = cfg.step_days, cfg.test_window_days, cfg.min_train_samples
    fitted = dict(models)

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(**{date: pd.to_datetime(pdf[date])}).sort_values(date, kind="stable")
        head = pdf.iloc[0]
        first_end, run, last_id = pd.Timestamp(head["_first_end"]), int(head["_run"]), int(head["_last"])
        rows = pdf[columns].reset_index(drop=True)
        days, out = rows[date], []
        truth = rows[target].to_numpy(dtype=float)
        for window_id in range(run * windows_per_task, min((run + 1) * windows_per_task, last_id + 1)):
            train_end = first_end + pd.Timedelta(days=step * window_id)
            begin = pd.Timestamp(head["_lo"]) + pd.Timedelta(days=step * window_id if rolling else 0)
            edges = [begin, train_end + pd.Timedelta(days=1), train_end + pd.Timedelta(days=test_days + 1)]
            lo, mid, hi = days.searchsorted(edges)
            if mid - lo < least or hi == mid:
                continue
            for name, model in fitted.items():
                yhat, error = np.full(hi - mid, np.nan), None
                try:
                    given = np.asarray(model(rows.iloc[lo:mid].copy(), rows.iloc[mid:hi].copy()), dtype=float)
                    if given.shape != yhat.shape:
                        raise ValueError(f"expected {hi - mid} predictions, got shape {given.shape}")
                    yhat = given
                except Exception as e:  # noqa: BLE001 - the failure becomes a row
                    error = f"{type(e).__name__}: {e}"
                out.append((window_id, mid, hi, name, yhat, error))
        if not out:
            return pd.DataFrame(columns=names)
        at = np.concatenate([np.arange(mid, hi) for _, mid, hi, _, _, _ in out])
        times = [hi - mid for _, mid, hi, _, _, _ in out]
        result = rows[[*keys, date]].iloc[at].reset_index(drop=True)
        return result.assign(
            **{date: result[date].dt.date},
            window_id=np.repeat([o[0] for o in out], times),
            model=np.repeat(np.array([o[3] for o in out], dtype=object), times),
            y=truth[at],
            yhat=np.concatenate([o[4] for o in out]),
            error=np.repeat(np.array([o[5] for o in out], dtype=object), times),
        )[names]

    predicted = spread(placed, *keys, "_run").groupBy(*keys, "_run").applyInPandas(evaluate, schema)
    none = F.lit(None).cast("double")
    return predicted.withColumns({"y": F.nanvl("y", none), "yhat": F.nanvl("yhat", none)})


def window_metrics(
    predictions: DataFrame, keys: Sequence[str] = (), y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Errors per window and model, over all series or per series with ``keys``."""
    usable = predictions.where(F.col("error").isNull()) if "error" in predictions.columns else predictions
    return usable.groupBy(*keys, "window_id", "model").agg(*all_metrics(y, yhat))


def backtest_report(metrics: DataFrame, windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Window dates next to the errors, one row per window and model."""
    return metrics.join(windows, [*keys, "window_id"]).select(
        *keys, "window_id", "train_start", "train_end", "test_start", "test_end", "model", *METRICS
    )


def flat_report(report: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Series keys, window id, formatted test start, model and errors; the keys are those in the report."""
    keys = [k for k in KEYS if k in report.columns] if keys is None else keys
    return report.withColumn("test_start", F.date_format("test_start", "yyyy-MM-dd")).select(
        *keys, "window_id", "test_start", "model", *METRICS
    )


def aggregate_metrics(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each error per model, over the windows."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return metrics.groupBy(*keys, "model").agg(*aggs)


def model_names(predictions: DataFrame) -> list[str]:
    """The models of a prediction table, sorted."""
    return [r["model"] for r in predictions.select("model").distinct().orderBy("model").collect()]


def loss_differences(
    predictions: DataFrame,
    models: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Count, mean and variance of the difference of squared errors for each pair of models, overall or per ``by``.

    The losses of a row are brought next to each other by one grouping; each pair is then
    a set of three running sums, so the rows are not joined with themselves.
    """
    names = sorted(models) if models is not None else model_names(predictions)
    loss = (F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))
    wide = predictions.groupBy(*keys, "window_id", date).agg(
        *[F.max(F.when(F.col("model") == m, loss)).alias(f"_loss_{i}") for i, m in enumerate(names)]
    )
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    schema = T.StructType([*[predictions.schema[k] for k in by]])
    if not pairs:
        empty = T.StructType(
            [
                *schema.fields,
                T.StructField("model_a", T.StringType()),
                T.StructField("model_b", T.StringType()),
                T.StructField("n", T.LongType()),
                T.StructField("mean", T.DoubleType()),
                T.StructField("variance", T.DoubleType()),
            ]
        )
        return predictions.sparkSession.createDataFrame([], empty)
    aggs = []
    for p, (i, j) in enumerate(pairs):
        d = F.col(f"_loss_{i}") - F.col(f"_loss_{j}")
        aggs += [F.count(d).alias(f"_n_{p}"), F.avg(d).alias(f"_m_{p}"), F.var_samp(d).alias(f"_v_{p}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("model_a"),
                F.lit(names[j]).alias("model_b"),
                F.col(f"_n_{p}").alias("n"),
                F.col(f"_m_{p}").alias("mean"),
                F.col(f"_v_{p}").alias("variance"),
            )
            for p, (i, j) in enumerate(pairs)
        ]
    )
    return wide.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def diebold_mariano(
    predictions: DataFrame,
    models: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Test of equal squared error for each pair of models, overall or per ``by``."""
    stats = loss_differences(predictions, models, keys, date, by).where(F.col("n") > 1)
    ratio = F.try_divide(F.col("mean"), F.sqrt(F.col("variance") / F.col("n")))
    statistic = F.when(F.col("variance") == 0, F.lit(0.0)).otherwise(ratio)
    return stats.select(*by, "model_a", "model_b", "n", statistic.alias("statistic")).withColumn(
        "p_value", two_sided_p("statistic")
    )
