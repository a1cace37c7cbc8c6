"""Spectrum, dominant periods, autocorrelation and decomposition of every series.

The grouped functions receive one series, at most one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast import DATE, KEYS, TARGET
from retailcast.operators.panel import densify, series_window

MAX_ACF_LAGS = 400
MAX_PACF_LAGS = 50
MAX_PEAKS = 5


def _schema(df: DataFrame, keys: Sequence[str], **fields: T.DataType) -> T.StructType:
    own = [T.StructField(n, t) for n, t in fields.items()]
    return T.StructType([*[df.schema[k] for k in keys], *own])


def _ordered(pdf: pd.DataFrame, date: str, target: str) -> np.ndarray:
    if pdf[date].duplicated().any():
        raise ValueError(f"more than one row of a series on a day: {pdf.iloc[0].to_dict()}")
    return pdf.sort_values(date)[target].to_numpy(dtype=float)


def spectrum(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    sampling_rate: float = 1.0,
) -> DataFrame:
    """Magnitude of the Fourier transform of the centred series at its positive frequencies.

    Rows (keys, k, n, frequency, magnitude). The Nyquist frequency is left out; series of
    fewer than four rows, and series with a null, give none.
    """
    schema = _schema(
        df, keys, k=T.IntegerType(), n=T.IntegerType(), frequency=T.DoubleType(), magnitude=T.DoubleType()
    )

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _ordered(pdf, date, target)
        n = len(x)
        k = np.arange(1, (n - 1) // 2 + 1)
        if n < 4 or np.isnan(x).any():
            k = k[:0]
        own = {key: pdf[key].iloc[0] for key in keys}
        magnitude = np.abs(np.fft.rfft(x - x.mean()))[k] if len(k) else []
        # k times the resolution, as the periods are truncated from this product
        frequency = k * (1.0 / (n * (1.0 / sampling_rate)))
        out = pd.DataFrame({"k": k, "n": n, "frequency": frequency, "magnitude": magnitude})
        return out.assign(**own)[[f.name for f in schema]]

    return df.select(*keys, date, target).groupBy(*keys).applyInPandas(transform, schema)


def spectral_peaks(spec: DataFrame, keys: Sequence[str] = KEYS, max_peaks: int = MAX_PEAKS) -> DataFrame:
    """The first peaks by frequency with their period and strength.

    A peak is a local maximum not below the mean magnitude; of a plateau the middle
    counts, and the two ends of the spectrum are never peaks.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    whole = Window.partitionBy(*keys)
    runs = (
        spec.withColumn("_start", (~F.col("magnitude").eqNullSafe(F.lag("magnitude").over(w))).cast("int"))
        .withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"_mean": F.avg("magnitude").over(whole), "_max": F.max("magnitude").over(whole)})
    )
    plateaus = runs.groupBy(*keys, "_run").agg(
        F.floor((F.min("k") + F.max("k")) / 2).cast("int").alias("k"),
        *[F.first(c).alias(c) for c in ("n", "magnitude", "_mean", "_max")],
        # the middle of the plateau: k times the same resolution
        F.first(F.col("frequency") / F.col("k")).alias("_resolution"),
        F.min("frequency").alias("_low"),
        F.min("k").alias("_k"),
    )
    along = Window.partitionBy(*keys).orderBy("_run")
    m = F.col("magnitude")
    peak = (F.lag(m).over(along) < m) & (F.lead(m).over(along) < m) & (m >= F.col("_mean"))
    frequency = F.when(F.col("k") == F.col("_k"), F.col("_low")).otherwise(F.col("k") * F.col("_resolution"))
    return (
        plateaus.withColumns({"_peak": peak, "frequency": frequency})
        .where("_peak")
        .withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("k")))
        .where((F.col("_place") <= max_peaks) & (F.col("_max") > 0))
        .select(
            *keys,
            "k",
            "frequency",
            (F.lit(1.0) / F.col("frequency")).cast("int").alias("period"),
            (m / F.col("_max")).alias("strength"),
        )
        .where(F.col("period") > 0)
    )


def autocovariance(x: np.ndarray, lags: int) -> np.ndarray:
    """Sums of products of the centred series with itself, lags 0..lags."""
    centred = x - x.mean()
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(centred, size)
    return np.fft.irfft(f * np.conj(f), size)[: lags + 1]


def acf_values(x: np.ndarray, lags: int) -> np.ndarray:
    sums = autocovariance(x, lags)
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums / sums[0]


def pacf_values(x: np.ndarray, lags: int) -> np.ndarray:
    """Last Yule-Walker coefficient of each order, covariances divided by n - k (Levinson-Durbin)."""
    r = autocovariance(x, lags) / (len(x) - np.arange(lags + 1))
    out = np.full(lags + 1, np.nan)
    out[0] = 1.0
    phi, error = np.zeros(0), r[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(1, lags + 1):
            last = (r[k] - phi @ r[k - 1 : 0 : -1]) / error
            phi = np.append(phi - last * phi[::-1], last)
            error *= 1.0 - last * last
            out[k] = last
    return out


def correlogram(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    max_lags: int = MAX_ACF_LAGS,
    max_pacf_lags: int = MAX_PACF_LAGS,
    band: bool = False,
) -> DataFrame:
    """Autocorrelation and partial autocorrelation per lag; ``pacf`` is null past its last lag.

    Nulls of the series are dropped first; a series too short for one lag gives lag 0 only.
    ``band`` limits the lags as the report does and adds the 95 % band.
    """
    fields = {"lag": T.IntegerType(), "acf": T.DoubleType(), "pacf": T.DoubleType(), "n": T.IntegerType()}
    schema = _schema(df, keys, **fields)

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {key: pdf[key].iloc[0] for key in keys}
        x = _ordered(pdf, date, target)
        x = x[~np.isnan(x)]
        n = len(x)
        lags = min(max_lags, n // 2 - 1)
        plags = max(1, min(lags, n // 4)) if band else min(max_pacf_lags, n // 4)
        if lags < (2 if band else 1) or plags < 1:
            acf, pacf = np.ones(1), np.ones(1)
            if band:
                acf, pacf = acf[:0], pacf[:0]
        else:
            acf, pacf = acf_values(x, lags), pacf_values(x, plags)
        size = max(len(acf), len(pacf))
        fill = lambda v: np.append(v, np.full(size - len(v), np.nan))
        out = pd.DataFrame({"lag": np.arange(size), "acf": fill(acf), "pacf": fill(pacf), "n": n})
        return out.assign(**own)[[f.name for f in schema]]

    rows = df.select(*keys, date, target).groupBy(*keys).applyInPandas(correlate, schema)
    none = F.lit(None).cast("double")
    rows = rows.withColumns({"acf": F.nanvl("acf", none), "pacf": F.nanvl("pacf", none)})
    return rows.withColumn("band", F.lit(1.96) / F.sqrt("n")) if band else rows


def report_correlogram(
    df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE, target: str = TARGET
) -> DataFrame:
    """Correlogram of the dense, forward-filled series with its 95 % band, up to 50 lags."""
    dense = densify(df, keys, date, (target,), fill="ffill")
    return correlogram(dense, keys, date, target, max_lags=50, band=True)


def analyze(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    max_lags: int = MAX_ACF_LAGS,
) -> DataFrame:
    """One row per series: periods by strength, strength at 7, 30 and 365 days, ACF and PACF."""
    corr = correlogram(df, keys, date, target, max_lags)
    at = lambda lag: F.coalesce(F.max(F.when(F.col("lag") == lag, F.col("acf"))), F.lit(0.0))
    listed = lambda c: F.transform(
        F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("lag", c)))), lambda s: s[c]
    )
    strengths = corr.groupBy(*keys).agg(
        at(7).alias("weekly_strength"),
        at(30).alias("monthly_strength"),
        at(365).alias("yearly_strength"),
        listed("acf").alias("acf_values"),
        listed("pacf").alias("pacf_values"),
    )
    # strongest first, the lower frequency first among equals
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("strength"), F.col("k"), F.col("period"))))
    peaks = spectral_peaks(spectrum(df, keys, date, target), keys).groupBy(*keys).agg(
        F.transform(ranked, lambda s: s["period"]).alias("dominant_periods")
    )
    joined = strengths.join(peaks, list(keys), "left") if keys else strengths.join(peaks, how="left")
    none = F.array().cast("array<int>")
    return joined.select(
        *keys,
        F.coalesce("dominant_periods", none).alias("dominant_periods"),
        "weekly_strength",
        "monthly_strength",
        "yearly_strength",
        "acf_values",
        "pacf_values",
    )


def decompose(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    period: int = 7,
    min_rows: int = 14,
) -> DataFrame:
    """Additive trend, seasonal and residual of the dense, forward-filled series.

    All windows are over the series, so one exchange serves them. Series of fewer than
    ``min_rows`` days are left out.
    """
    w = series_window(keys, date)
    whole = Window.partitionBy(*keys)
    dense = densify(df, keys, date, (target,), fill="ffill").withColumns(
        {"_t": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)}
    )
    half = period // 2
    inner = w.rowsBetween(-half, half)
    if period % 2:
        mean = F.sum(target).over(inner) / period
    else:  # the two ends count half
        ends = F.lag(target, half).over(w) + F.lead(target, half).over(w)
        mean = (F.sum(target).over(inner) - ends * 0.5) / period
    full = F.count(target).over(inner) == 2 * half + 1
    trended = dense.where(F.col("_n") >= min_rows).withColumn("trend", F.when(full, mean))
    phases = trended.withColumns({"_d": F.col(target) - F.col("trend"), "_p": F.col("_t") % period})
    means = F.array(*[F.avg(F.when(F.col("_p") == p, F.col("_d"))).over(whole) for p in range(period)])
    level = F.aggregate("_means", F.lit(0.0), lambda a, x: a + x) / period
    return (
        phases.withColumn("_means", means)
        .withColumn("seasonal", F.get("_means", F.col("_p")) - level)
        .withColumn("resid", F.col(target) - F.col("trend") - F.col("seasonal"))
        .select(*keys, date, target, "trend", "seasonal", "resid")
    )
