"""Recurrent forecaster: an echo state network (Jaeger 2001) over every series.

A fixed recurrent layer with hash-drawn weights is driven by the scaled rows of a series; its state at a day sums
up all days before it. Only the readout is trained: one ridge regression from states to the next ``horizon`` values,
by normal equations summed over the cluster. The state is all that a series carries from one run of rows to the next, so
``advance`` can go on from a stored state when new rows arrive.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast import DATE, KEYS, TARGET
from retailcast.models.sequence import SequenceConfig, _normal_equations, _scaled_panel, readout, ridge_path
from retailcast.operators.panel import require_daily_grain, series_window


@dataclass(frozen=True)
class ReservoirConfig:
    units: int = 64
    horizon: int = 28
    washout: int = 28  # rows of a part before its first window; the state of a new series starts at zero
    leak: float = 0.5
    radius: float = 0.9
    links: int = 8  # recurrent inputs of a unit
    input_scale: float = 1.0
    seed: int = 42
    train_share: float = 0.8
    penalties: tuple[float, ...] = (10000.0, 1000.0, 100.0, 30.0, 10.0, 3.0, 1.0, 0.3, 0.1, 0.03, 0.01, 1e-3, 1e-4, 1e-5)
    patience: int = 3
    fit_on: str = "train"


def hash_uniform(count: int, stream: int, seed: int) -> np.ndarray:
    """``count`` numbers of [-1, 1) by the SplitMix64 finaliser of their place: the same on every machine."""
    with np.errstate(over="ignore"):
        base = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream) * np.uint64(0xD1B54A32D192ED03)
        z = base + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1.0


@lru_cache(maxsize=8)
def layer(cfg: ReservoirConfig, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Input weights (units, 1 + inputs) and recurrent weights (units, units) with the spectral radius asked for."""
    n = cfg.units
    into = hash_uniform(n * (1 + inputs), 1, cfg.seed).reshape(n, 1 + inputs) * cfg.input_scale
    weights = hash_uniform(n * n, 2, cfg.seed).reshape(n, n)
    order = np.argsort(hash_uniform(n * n, 3, cfg.seed).reshape(n, n), axis=1, kind="stable")
    linked = np.zeros((n, n), dtype=bool)
    np.put_along_axis(linked, order[:, : min(cfg.links, n)], True, axis=1)
    weights = np.where(linked, weights, 0.0)
    radius = float(np.abs(np.linalg.eigvals(weights)).max())
    return into, weights * (cfg.radius / radius if radius > 0 else 0.0)


def advance(rows: np.ndarray, cfg: ReservoirConfig, state: np.ndarray | None = None) -> np.ndarray:
    """States after each of the rows (rows, inputs), going on from ``state`` (zero for a new series)."""
    rows = np.asarray(rows, dtype=np.float64)
    into, weights = layer(cfg, rows.shape[1])
    driven = into[:, 0] + rows @ into[:, 1:].T
    now = np.zeros(cfg.units) if state is None else np.asarray(state, dtype=np.float64)
    out = np.empty((len(rows), cfg.units))
    for i in range(len(rows)):
        now = (1.0 - cfg.leak) * now + cfg.leak * np.tanh(driven[i] + weights @ now)
        out[i] = now
    return out


def _states(panel: DataFrame, cfg: ReservoirConfig, keys, date, inputs: int, kept: Sequence[str], last: bool) -> DataFrame:
    """(keys, date, kept, x): the state after each row whose answer is whole, or after the last row of a series."""
    columns = [f"_s{i}" for i in range(inputs)]
    schema = T.StructType(
        [*[panel.schema[c] for c in (*keys, date, *kept)], T.StructField("x", T.ArrayType(T.DoubleType()))]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable")
        states = advance(pdf[columns].to_numpy(np.float64), cfg)
        chosen = np.array([len(pdf) - 1]) if last else np.flatnonzero(pdf["_usable"].to_numpy(bool))
        out = pdf.iloc[chosen][[*keys, date, *kept]]
        # of type object also when empty
        return out.assign(x=pd.Series(list(states[chosen]), index=out.index, dtype=object))

    return require_daily_grain(panel, keys, date).groupBy(*keys).applyInPandas(run, schema)


def reservoir_windows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    features: Sequence[str] = (),
    cfg: ReservoirConfig = ReservoirConfig(),
) -> DataFrame:
    """(keys, date, is_train, x, y): the state up to a date and the scaled values of the following horizon.

    No answer crosses the border of train and validation rows, and the first ``washout - 1`` rows of either part give
    none, so that the windows are those of the linear map with a lookback of ``washout`` rows. States do cross it: they
    rest on earlier rows only. Rows with a null in any column are left out; a series is bounded by its days.
    """
    panel = _windowed(df, keys, date, target, features, cfg)
    return _states(panel, cfg, keys, date, 1 + len(features), ("is_train", "y"), last=False)


def _windowed(df, keys, date, target, features, cfg: ReservoirConfig) -> DataFrame:
    scaling = SequenceConfig(train_share=cfg.train_share, fit_on=cfg.fit_on)
    panel = _scaled_panel(df, scaling, keys, date, target, features)
    w = series_window([*keys, "is_train"], date)
    answered = panel.withColumns(
        {"y": F.collect_list("_s0").over(w.rowsBetween(1, cfg.horizon)), "_place": F.row_number().over(w)}
    )
    usable = (F.size("y") == cfg.horizon) & (F.col("_place") >= cfg.washout)
    return answered.withColumn("_usable", usable).drop("_place")


@dataclass
class ReservoirModel:
    """Readout weights (1 + units, horizon); the layer follows from the configuration."""

    beta: np.ndarray
    history: list[tuple[int, float, float, float, bool]]
    cfg: ReservoirConfig
    keys: tuple[str, ...]
    features: tuple[str, ...]

    def losses(self, spark) -> DataFrame:
        """(step, penalty, train_loss, val_loss, best) in the order tried."""
        return spark.createDataFrame(
            self.history, "step int, penalty double, train_loss double, val_loss double, best boolean"
        )

    def save(self, spark, path: str) -> None:
        """A row of weights for each day ahead, with all that ``load`` needs: configuration, keys and features."""
        about = json.dumps({"config": asdict(self.cfg), "keys": self.keys, "features": self.features})
        rows = [(h, [float(v) for v in self.beta[:, h]], about) for h in range(self.beta.shape[1])]
        spark.createDataFrame(rows, "step int, beta array<double>, about string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> ReservoirModel:
        rows = spark.read.parquet(path).orderBy("step").collect()
        about = json.loads(rows[0]["about"])
        about["config"]["penalties"] = tuple(about["config"]["penalties"])
        cfg = ReservoirConfig(**about["config"])
        return cls(np.array([r["beta"] for r in rows]).T, [], cfg, tuple(about["keys"]), tuple(about["features"]))

    def predict(self, df: DataFrame, date: str = DATE, target: str = TARGET) -> DataFrame:
        """(keys, date, yhat) for the horizon after each series with at least ``washout`` known rows."""
        cfg, keys = self.cfg, list(self.keys)
        scaling = SequenceConfig(train_share=cfg.train_share, fit_on=cfg.fit_on)
        panel = _scaled_panel(df, scaling, keys, date, target, self.features)
        panel = panel.withColumn("_n", F.row_number().over(series_window(keys, date)))
        last = _states(panel, cfg, keys, date, 1 + len(self.features), ("_lo0", "_hi0", "_n"), last=True)
        inputs = F.concat(F.array(F.lit(1.0)), "x").alias("_x")
        last = last.where(F.col("_n") >= cfg.washout).select(*keys, date, "_lo0", "_hi0", inputs)
        return readout(last, self.beta, keys, date)


def fit_reservoir(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    features: Sequence[str] = (),
    cfg: ReservoirConfig = ReservoirConfig(),
) -> ReservoirModel | None:
    """Train the readout over all series; None when no series has a whole window of train rows.

    The states never leave the tasks that compute them: each task adds up its own normal equations.
    ``keys=()`` takes the frame as one series.
    """
    windows = reservoir_windows(df, keys, date, target, features, cfg)
    sums = _normal_equations(windows, cfg.units, cfg.horizon)
    if True not in sums:
        return None
    beta, history = ridge_path(sums, cfg.penalties, cfg.patience)
    return ReservoirModel(beta, history, cfg, tuple(keys), tuple(features))
