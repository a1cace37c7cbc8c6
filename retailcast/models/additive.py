"""Additive forecaster: piecewise-linear trend, yearly and weekly waves, holidays, regressors.

After Taylor and Letham (2018). Every series is one small regularised regression, so a fit
is a grouped job whose result is a table with a row of coefficients per series; prediction
brings a series' days and its row together again.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast import DATE, KEYS, TARGET
from retailcast.config import BacktestConfig
from retailcast.models.reservoir import hash_uniform
from retailcast.operators.joins import join_per_date, lookup_join
from retailcast.operators.panel import require_daily_grain, spread


@dataclass(frozen=True)
class AdditiveConfig:
    yearly_order: int = 10
    weekly_order: int = 3
    daily_order: int = 0
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    interval_width_z: float = 1.96
    sweeps: int = 5
    trend_paths: int = 0  # simulated futures of the trend behind the bounds; 0 for bounds by formula
    seed: int = 42


COEFFICIENTS = [
    T.StructField("start", T.DateType()),
    T.StructField("last", T.DateType()),
    T.StructField("t_scale", T.DoubleType()),
    T.StructField("y_scale", T.DoubleType()),
    T.StructField("changepoints", T.ArrayType(T.DoubleType())),
    T.StructField("names", T.ArrayType(T.StringType())),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("centers", T.ArrayType(T.DoubleType())),
    T.StructField("spreads", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("n", T.LongType()),
]


def holiday_windows(holidays: DataFrame, lower: int = -1, upper: int = 1, date: str = DATE) -> DataFrame:
    """Rows (date, holiday, offset): every holiday on its day and on the days around it."""
    around = F.explode(F.sequence(F.lit(lower), F.lit(upper)))
    days = holidays.select(F.expr(f"try_cast(`{date}` AS date)").alias("_day"), F.col("description").alias("holiday"))
    return days.where(F.col("_day").isNotNull()).select("_day", "holiday", around.alias("offset")).select(
        F.date_add("_day", F.col("offset")).alias(date), "holiday", "offset"
    )


def _labels(holidays: DataFrame, date: str) -> DataFrame:
    """One row per date with the labels of the holiday effects on it."""
    label = F.concat_ws("|", "holiday", F.col("offset").cast("string"))
    return holiday_windows(holidays, date=date).groupBy(date).agg(F.array_sort(F.collect_set(label)).alias("_labels"))


def prepare(
    df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE, target: str = TARGET, regressors: Sequence[str] = ()
) -> DataFrame:
    """Columns (keys, ds, y, regressors) without nulls; the regressors stay with their rows."""
    none = F.lit(None).cast("double")
    y = F.nanvl(F.col(target).cast("double"), none)
    return df.select(*keys, F.expr(f"try_cast(`{date}` AS date)").alias("ds"), y.alias("y"), *regressors).dropna()


def _basis(ds: pd.Series, cfg: AdditiveConfig) -> np.ndarray:
    """Sine and cosine columns by days since 1970."""
    days = (pd.to_datetime(ds).to_numpy("datetime64[D]").astype(int)).astype(float)
    waves = []
    for length, order in ((365.25, cfg.yearly_order), (7.0, cfg.weekly_order), (1.0, cfg.daily_order)):
        for k in range(1, order + 1):
            angle = 2.0 * np.pi * k * days / length
            waves += [np.sin(angle), np.cos(angle)]
    return np.column_stack(waves) if waves else np.zeros((len(days), 0))


def _label_columns(labels: pd.Series | None, names: Sequence[str], size: int) -> np.ndarray:
    out = np.zeros((size, len(names)))
    if labels is not None and len(names):
        at = {n: i for i, n in enumerate(names)}
        for row, found in enumerate(labels):
            for name in found if found is not None else ():
                if name in at:
                    out[row, at[name]] = 1.0
    return out


def _design(pdf, start, t_scale, changepoints, names, centers, spreads, regressors, cfg) -> np.ndarray:
    days = (pd.to_datetime(pdf["ds"]) - pd.Timestamp(start)).dt.days.to_numpy(dtype=float)
    t = days / t_scale
    hinges = np.maximum(t[:, None] - np.asarray(changepoints, dtype=float)[None, :], 0.0)
    extra = (
        (pdf[list(regressors)].to_numpy(dtype=float) - np.asarray(centers)) / np.asarray(spreads)
        if regressors
        else np.zeros((len(pdf), 0))
    )
    labels = _label_columns(pdf["_labels"] if "_labels" in pdf else None, names, len(pdf))
    return np.column_stack([np.ones(len(t)), t, hinges, _basis(pdf["ds"], cfg), labels, extra])


def priors(n_cp: int, n_labels: int, n_regressors: int, cfg: AdditiveConfig) -> np.ndarray:
    """Prior scale of every column of the design."""
    n_waves = 2 * (cfg.yearly_order + cfg.weekly_order + cfg.daily_order)
    return np.concatenate(
        [
            [5.0, 5.0],
            np.full(n_cp, cfg.changepoint_prior_scale),
            np.full(n_waves, cfg.seasonality_prior_scale),
            np.full(n_labels, cfg.holidays_prior_scale),
            np.full(n_regressors, cfg.seasonality_prior_scale),
        ]
    )


def reweighted(
    gram: np.ndarray, cross: np.ndarray, square: float, n: int, prior: np.ndarray, n_cp: int, cfg: AdditiveConfig
) -> tuple[np.ndarray, float]:
    """Coefficients and residual variance from the sums of products of ``n`` rows; the ``n_cp`` slope changes are sparse."""
    sigma2, change = 0.25, slice(2, 2 + n_cp)
    inverse = 1.0 / prior**2
    beta = np.zeros(len(prior))
    for _ in range(cfg.sweeps):
        beta = np.linalg.solve(gram + sigma2 * np.diag(inverse) + 1e-9 * np.eye(len(beta)), cross)
        residual = square - 2 * beta @ cross + beta @ gram @ beta
        sigma2 = max(residual / n, 1e-8)
        inverse[change] = 1.0 / (cfg.changepoint_prior_scale * np.maximum(np.abs(beta[change]), 1e-4))
    return beta, sigma2


def fit_series(pdf: pd.DataFrame, cfg: AdditiveConfig, regressors: Sequence[str] = ()) -> dict:
    """Coefficients of one series by reweighted ridge regression: Gaussian priors on waves
    and effects, a sparse (Laplace) prior on the changes of slope."""
    pdf = pdf.sort_values("ds")
    start, last = pdf["ds"].iloc[0], pdf["ds"].iloc[-1]
    t_scale = float(max((pd.Timestamp(last) - pd.Timestamp(start)).days, 1))
    y = pdf["y"].to_numpy(dtype=float)
    y_scale = float(np.abs(y).max()) or 1.0
    n_cp = min(cfg.n_changepoints, max(int(len(y) * cfg.changepoint_range) - 1, 0))
    t = (pd.to_datetime(pdf["ds"]) - pd.Timestamp(start)).dt.days.to_numpy(dtype=float) / t_scale
    at = np.linspace(0, max(int(len(y) * cfg.changepoint_range) - 1, 0), n_cp + 1).round().astype(int)[1:]
    changepoints = t[at]
    found = pdf["_labels"] if "_labels" in pdf else []
    names = sorted({name for labels in found if labels is not None for name in labels})
    values = pdf[list(regressors)].to_numpy(dtype=float) if regressors else np.zeros((len(y), 0))
    centers, spreads = values.mean(axis=0), values.std(axis=0)
    spreads = np.where(spreads > 0, spreads, 1.0)
    x = _design(pdf, start, t_scale, changepoints, names, centers, spreads, regressors, cfg)
    prior = priors(n_cp, len(names), len(regressors), cfg)
    target = y / y_scale
    beta, sigma2 = reweighted(x.T @ x, x.T @ target, float(target @ target), len(y), prior, n_cp, cfg)
    return {
        "start": start,
        "last": last,
        "t_scale": t_scale,
        "y_scale": y_scale,
        "changepoints": changepoints.tolist(),
        "names": names,
        "beta": beta.tolist(),
        "centers": centers.tolist(),
        "spreads": spreads.tolist(),
        "sigma": float(np.sqrt(sigma2)),
        "n": len(y),
    }


def simulated_bounds(ahead: np.ndarray, changes: float, size: float, sigma: float, stream: int, cfg: AdditiveConfig) -> tuple[np.ndarray, ...]:
    """Lower and upper offsets from the forecast at times after the history, as quantiles over simulated futures.

    A future has Poisson many slope changes, ``changes`` for each length of the history, at even times and of Laplace
    sizes with mean ``size``, and normal noise on each day. Every draw is a hash of seed, ``stream`` and its place.
    """
    paths, span = cfg.trend_paths, float(ahead.max(initial=0.0))
    rate = changes * span
    # counts by inversion; no future of the largest draw has more than this
    most = int(np.ceil(rate + 10 * np.sqrt(rate) + 20))
    counts = np.arange(most)
    logs = counts * np.log(max(rate, 1e-300)) - rate - np.concatenate([[0.0], np.cumsum(np.log(counts[1:]))])
    share = lambda n, draw: (hash_uniform(n, 8 * stream + draw, cfg.seed) + 1.0) / 2.0
    number = np.searchsorted(np.cumsum(np.exp(logs)), share(paths, 0)).clip(max=most)
    when = share(paths * most, 1).reshape(paths, most) * span
    side = share(paths * most, 2).reshape(paths, most) - 0.5
    slope = -size * np.sign(side) * np.log(np.maximum(1.0 - 2.0 * np.abs(side), 1e-300))
    slope = np.where(np.arange(most) < number[:, None], slope, 0.0)
    drift = np.zeros((paths, len(ahead)))
    for j in range(most):
        drift += slope[:, j, None] * np.maximum(ahead - when[:, j, None], 0.0)
    cells = paths * len(ahead)
    noise = np.sqrt(-2.0 * np.log(1.0 - share(cells, 3))) * np.cos(2.0 * np.pi * share(cells, 4))
    tail = 0.5 * (1.0 + math.erf(cfg.interval_width_z / math.sqrt(2.0)))
    low, high = np.quantile(drift + sigma * noise.reshape(drift.shape), [1.0 - tail, tail], axis=0)
    return low, high


def predict_series(
    pdf: pd.DataFrame, model, cfg: AdditiveConfig, regressors: Sequence[str] = (), stream: int = 0
) -> pd.DataFrame:
    """Forecast with bounds: noise plus, after the history, slope changes as frequent and
    as large as those of the history. With ``trend_paths`` the bounds after the history are those of simulated
    futures, ``stream`` telling series apart; the bounds inside it are the noise alone in either case."""
    changepoints = np.asarray(model["changepoints"], dtype=float)
    x = _design(
        pdf, model["start"], model["t_scale"], changepoints, list(model["names"]),
        model["centers"], model["spreads"], regressors, cfg,
    )
    beta = np.asarray(model["beta"], dtype=float)
    yhat = x @ beta
    days = (pd.to_datetime(pdf["ds"]) - pd.Timestamp(model["last"])).dt.days.to_numpy(dtype=float)
    ahead = np.maximum(days, 0.0) / model["t_scale"]
    change = beta[2 : 2 + len(changepoints)]
    size = float(np.abs(change).mean()) if len(change) else 0.0
    variance = model["sigma"] ** 2 + 2.0 * size**2 * len(changepoints) * ahead**3 / 3.0
    width = cfg.interval_width_z * np.sqrt(variance)
    low, high = -width, width
    later = ahead > 0
    if cfg.trend_paths and later.any():
        low[later], high[later] = simulated_bounds(ahead[later], len(changepoints), size, model["sigma"], stream, cfg)
    scale = model["y_scale"]
    return pdf.assign(yhat=yhat * scale, lower=(yhat + low) * scale, upper=(yhat + high) * scale)


def fit_additive(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    holidays: DataFrame | None = None,
    regressors: Sequence[str] = (),
    cfg: AdditiveConfig = AdditiveConfig(),
) -> DataFrame:
    """A row of coefficients for every series with at least two known values."""
    rows = prepare(df, keys, date, target, regressors)
    if holidays is not None:
        rows = join_per_date(rows, _labels(holidays, DATE).withColumnRenamed(DATE, "ds"), "ds")
    schema = T.StructType([*[rows.schema[k] for k in keys], *COEFFICIENTS])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame(columns=[f.name for f in schema])
        own = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**own, **fit_series(pdf, cfg, regressors)}])

    return require_daily_grain(spread(rows, *keys), keys, "ds").groupBy(*keys).applyInPandas(fit, schema)


def predict_frame(
    df: DataFrame,
    coefficients: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    holidays: DataFrame | None = None,
    regressors: Sequence[str] = (),
    cfg: AdditiveConfig = AdditiveConfig(),
) -> DataFrame:
    """Forecast (keys, ds, yhat, lower, upper) for the days of a frame; series without a model are left out."""
    days = df.select(*keys, F.expr(f"try_cast(`{date}` AS date)").alias("ds"), *regressors)
    if holidays is not None:
        days = join_per_date(days, _labels(holidays, DATE).withColumnRenamed(DATE, "ds"), "ds")
    out = ("yhat", "lower", "upper")
    schema = T.StructType(
        [*[days.schema[k] for k in keys], T.StructField("ds", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in out]]
    )
    names = [f.name for f in schema]

    def predict(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        model = right.iloc[0]
        stream = zlib.crc32("|".join(str(model[k]) for k in keys).encode())
        # in order of days, as draws go by place
        return predict_series(left.sort_values("ds", kind="stable"), model, cfg, regressors, stream)[names]

    # renamed to itself: the days may come from the same table
    models = coefficients.select(*[F.col(c).alias(c) for c in coefficients.columns])
    return days.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInPandas(predict, schema)


def predict_additive(
    coefficients: DataFrame,
    periods: int = 28,
    keys: Sequence[str] = KEYS,
    history: DataFrame | None = None,
    date: str = DATE,
    holidays: DataFrame | None = None,
    future_regressors: DataFrame | None = None,
    regressors: Sequence[str] = (),
    cfg: AdditiveConfig = AdditiveConfig(),
) -> DataFrame:
    """Forecast of ``periods`` days after each series, preceded by the fitted history if given.

    ``coefficients`` is used twice, so pass a stored table rather than a fit in progress.
    ``future_regressors`` holds the regressor values by date, or by key and date.
    """
    steps = F.sequence(F.date_add("last", 1), F.date_add("last", periods))
    days = coefficients.select(*keys, F.explode(steps).alias(date))
    if future_regressors is not None:
        on = [c for c in (*keys, date) if c in future_regressors.columns]
        days = lookup_join(days, future_regressors, on)
    if history is not None:
        days = history.select(*keys, date, *regressors).unionByName(days.select(*keys, date, *regressors))
    return predict_frame(days, coefficients, keys, date, holidays, regressors, cfg)


def backtest_model(date: str = DATE, target: str = TARGET, cfg: AdditiveConfig = AdditiveConfig()):
    """The forecaster as a backtest model: fit on train, forecast the test days, not below 0."""

    def model(train: pd.DataFrame, test: pd.DataFrame) -> np.ndarray:
        known = train[[date, target]].rename(columns={date: "ds", target: "y"}).dropna()
        days = test[[date]].rename(columns={date: "ds"})
        forecast = predict_series(days, fit_series(known, cfg), cfg)
        return np.clip(forecast["yhat"].to_numpy(), 0.0, None)

    return model


def window_basis(days: np.ndarray, cfg: AdditiveConfig) -> tuple[np.ndarray, np.ndarray]:
    """The design of all days of a series, and the times of its slope changes, as shares of the whole series.

    The changes lie on an even grid over the first ``changepoint_range`` of the series, the same for all windows.
    """
    span = max(float(days[-1] - days[0]), 1.0)
    t = (days - days[0]) / span
    knots = np.linspace(0, cfg.changepoint_range, cfg.n_changepoints + 1)[1:]
    waves = _basis(pd.Series(days.astype("datetime64[D]")), cfg)
    return np.column_stack([np.ones(len(t)), t, np.maximum(t[:, None] - knots, 0.0), waves]), knots


def window_predictions(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    windows: BacktestConfig = BacktestConfig(),
    cfg: AdditiveConfig = AdditiveConfig(),
    name: str = "additive",
) -> DataFrame:
    """Backtest predictions of the additive forecaster in expanding windows: (keys, window_id, date, model, y, yhat).

    All windows of a series share one basis, and the sums of products of its rows run along: a window adds the rows since the
    one before and solves a system of the size of the basis, so training rows are read once and not once a window. Knots and
    the time scale therefore do not move with the window; a window uses the knots in the first ``changepoint_range`` of its training
    period. A series is bounded by its days; forecasts are not below 0.
    """
    rows = require_daily_grain(spread(df.select(*keys, date, target), *keys), keys, date)
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_first", F.add_months(F.min(date).over(w), windows.train_window_months))
    rows = rows.withColumn(target, F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double")))
    schema = df.select(*keys, F.lit(0).alias("window_id"), date, F.lit(name).alias("model"), F.lit(0.0).alias("y"), F.lit(0.0).alias("yhat")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[date].notna()].sort_values(date, kind="stable")
        out = [pdf.iloc[:0][[*keys, date]].assign(window_id=0, model="", y=0.0, yhat=0.0)]
        if len(pdf):
            days = pd.to_datetime(pdf[date]).to_numpy("datetime64[D]").astype(int)
            first = np.datetime64(pdf["_first"].iloc[0], "D").astype(int)
            y = pdf[target].to_numpy(np.float64)
            for window_id, low, high, yhat in _windows(days, y, first, windows, cfg):
                part = pdf.iloc[low:high][[*keys, date]]
                out.append(part.assign(window_id=window_id, model=name, y=y[low:high], yhat=yhat))
        return pd.concat(out)[[f.name for f in schema]]

    none = F.lit(None).cast("double")
    return rows.groupBy(*keys).applyInPandas(run, schema).withColumn("y", F.nanvl("y", none))


def _windows(days, y, first, windows: BacktestConfig, cfg: AdditiveConfig):
    """(id, first and last test row, forecast) of every window with enough training rows, from running sums."""
    x, knots = window_basis(days, cfg)
    known = ~np.isnan(y)
    size, n, read = x.shape[1], 0, 0
    gram, cross, square, scale = np.zeros((size, size)), np.zeros(size), 0.0, 0.0
    waves = np.arange(2 + len(knots), size)
    for window_id in range((days[-1] - first - windows.test_window_days) // windows.step_days + 1):
        train_end = first + window_id * windows.step_days
        low = int(np.searchsorted(days, train_end, "right"))
        high = int(np.searchsorted(days, train_end + windows.test_window_days, "right"))
        fresh = np.flatnonzero(known[read:low]) + read
        gram += x[fresh].T @ x[fresh]
        cross += x[fresh].T @ y[fresh]
        square += float(y[fresh] @ y[fresh])
        scale = max(scale, float(np.abs(y[fresh]).max(initial=0.0)))
        n, read = n + len(fresh), low
        if low < windows.min_train_samples or high <= low or n < 2:
            continue
        unit = scale or 1.0
        active = int((knots <= cfg.changepoint_range * (days[low - 1] - days[0]) / max(days[-1] - days[0], 1)).sum())
        chosen = np.concatenate([np.arange(2 + active), waves])
        sums = gram[np.ix_(chosen, chosen)], cross[chosen] / unit, square / unit**2
        beta, _ = reweighted(*sums, n, priors(active, 0, 0, cfg), active, cfg)
        yield window_id, low, high, np.clip(x[low:high][:, chosen] @ beta * unit, 0.0, None)
