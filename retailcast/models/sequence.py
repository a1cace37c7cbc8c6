"""Sequence forecaster: the last rows of a series give its next values directly.

Every lookback window is an example whose answer is the following horizon. One ridge
regression maps windows to horizons; its normal equations are summed over the cluster, so
the driver only solves systems of the size of a window.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast import DATE, KEYS, TARGET
from retailcast.operators.features import scaled, unscaled
from retailcast.operators.panel import series_split, series_window


@dataclass(frozen=True)
class SequenceConfig:
    lookback: int = 28
    horizon: int = 28
    train_share: float = 0.8
    penalties: tuple[float, ...] = (100.0, 30.0, 10.0, 3.0, 1.0, 0.3, 0.1, 0.03, 0.01)
    patience: int = 3
    fit_on: str = "train"


def supervised_windows(
    df: DataFrame,
    lookback: int = 28,
    horizon: int = 28,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    columns: Sequence[str] = (TARGET,),
    part: str | None = None,
) -> DataFrame:
    """(keys, date, x, y): ``x`` holds the rows up to the date (row by row, all columns), ``y`` the
    first column on the rows after it. A series of n rows gives n - lookback - horizon + 1.

    ``part`` names a column, such as a train flag, whose borders no window crosses.
    """
    within = [*keys, part] if part else list(keys)
    w = series_window(within, date)
    row = F.col(columns[0]) if len(columns) == 1 else F.array(*columns)
    seen = F.collect_list(row).over(w.rowsBetween(1 - lookback, 0))
    x = seen if len(columns) == 1 else F.flatten(seen)
    y = F.collect_list(columns[0]).over(w.rowsBetween(1, horizon))
    keep = [c for c in (part,) if c]
    return (
        df.dropna(subset=list(columns))
        .select(*keys, date, *keep, x.alias("x"), y.alias("y"))
        .where((F.size("x") == lookback * len(columns)) & (F.size("y") == horizon))
    )


def _scaled_panel(df, cfg: SequenceConfig, keys, date, target, features) -> DataFrame:
    """Columns scaled per series (``_s0`` is the target) with the bounds of the target and the train flag."""
    if cfg.fit_on not in ("train", "all"):
        raise ValueError(f"unknown scaling: {cfg.fit_on}")
    columns = [target, *features]
    rows = df.dropna(subset=columns).select(*keys, date, *columns)
    split = series_split(rows, keys, date, cfg.train_share)
    w = Window.partitionBy(*keys)
    seen = lambda c: F.when(F.col("is_train"), F.col(c)) if cfg.fit_on == "train" else F.col(c)
    bounds = {}
    for i, c in enumerate(columns):
        bounds[f"_lo{i}"] = F.min(seen(c)).over(w)
        bounds[f"_hi{i}"] = F.max(seen(c)).over(w)
    bounded = split.withColumns(bounds)
    values = {f"_s{i}": scaled(F.col(c), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, c in enumerate(columns)}
    return bounded.withColumns(values).select(*keys, date, "is_train", *values, "_lo0", "_hi0")


def _normal_equations(windows: DataFrame, width: int, horizon: int) -> dict[bool, tuple[np.ndarray, ...]]:
    """X'X, X'Y, Y'Y and the row count, for train and validation windows.

    Each task sums its windows; the partial sums, a matrix per task, are added by a grouped
    aggregate over matrix cells, and the driver receives one matrix per part.
    """
    side = width + 1

    def partial(batches):
        sums: dict[bool, list] = {}
        for pdf in batches:
            for flag, part in pdf.groupby("is_train"):
                x = np.column_stack([np.ones(len(part)), np.vstack(part["x"].to_numpy())])
                y = np.vstack(part["y"].to_numpy())
                new = [x.T @ x, x.T @ y, (y * y).sum(axis=0), np.array([float(len(part))])]
                old = sums.get(bool(flag))
                sums[bool(flag)] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
        for flag, parts in sums.items():
            yield pd.DataFrame({"is_train": [flag], "cells": [np.concatenate([p.ravel() for p in parts])]})

    cells = windows.select("is_train", "x", "y").mapInPandas(partial, "is_train boolean, cells array<double>")
    summed = cells.select("is_train", F.posexplode("cells").alias("at", "v")).groupBy("is_train", "at").agg(F.sum("v").alias("v"))
    ordered = summed.groupBy("is_train").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("c"))
    out = {}
    for row in ordered.select("is_train", F.transform("c", lambda s: s["v"]).alias("v")).collect():
        flat = np.array(row["v"])
        xx, xy, yy, n = np.split(flat, np.cumsum([side * side, side * horizon, horizon]))
        out[row["is_train"]] = (xx.reshape(side, side), xy.reshape(side, horizon), yy, float(n[0]))
    return out


def _loss(beta: np.ndarray, sums: tuple[np.ndarray, ...]) -> float:
    xx, xy, yy, n = sums
    total = yy.sum() - 2 * (beta * xy).sum() + np.einsum("ih,ij,jh->", beta, xx, beta)
    return float(max(total, 0.0) / (n * len(yy)))


@dataclass
class SequenceModel:
    beta: np.ndarray
    history: list[tuple[int, float, float, float, bool]]
    cfg: SequenceConfig
    keys: tuple[str, ...]
    features: tuple[str, ...]

    def losses(self, spark) -> DataFrame:
        """(step, penalty, train_loss, val_loss, best) in the order tried."""
        return spark.createDataFrame(
            self.history, "step int, penalty double, train_loss double, val_loss double, best boolean"
        )

    def save(self, spark, path: str) -> None:
        """A row of coefficients for each day ahead, with all that ``load`` needs: configuration, keys and features."""
        about = json.dumps({"config": asdict(self.cfg), "keys": self.keys, "features": self.features})
        rows = [(h, [float(v) for v in self.beta[:, h]], about) for h in range(self.beta.shape[1])]
        spark.createDataFrame(rows, "step int, beta array<double>, about string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(
        cls,
        spark,
        path: str,
        cfg: SequenceConfig | None = None,
        keys: Sequence[str] | None = None,
        features: Sequence[str] | None = None,
    ) -> SequenceModel:
        """The stored model; arguments replace what is stored (needed for tables without a description)."""
        rows = spark.read.parquet(path).orderBy("step").collect()
        stored = json.loads(rows[0]["about"]) if "about" in rows[0] else {}
        if cfg is None:
            values = stored["config"]
            cfg = SequenceConfig(**{**values, "penalties": tuple(values["penalties"])})
        keys = stored.get("keys", KEYS) if keys is None else keys
        features = stored.get("features", ()) if features is None else features
        return cls(np.array([r["beta"] for r in rows]).T, [], cfg, tuple(keys), tuple(features))

    def predict(self, df: DataFrame, date: str = DATE, target: str = TARGET) -> DataFrame:
        """(keys, date, yhat) for the horizon after each series that has a full lookback."""
        cfg, keys = self.cfg, list(self.keys)
        panel = _scaled_panel(df, cfg, keys, date, target, self.features)
        w = series_window(keys, date)
        columns = [f"_s{i}" for i in range(1 + len(self.features))]
        row = F.col("_s0") if len(columns) == 1 else F.array(*columns)
        seen = F.collect_list(row).over(w.rowsBetween(1 - cfg.lookback, 0))
        x = seen if len(columns) == 1 else F.flatten(seen)
        back = F.row_number().over(series_window(keys, F.col(date).desc()))
        last = (
            panel.withColumns({"_x": x, "_back": back})
            .where((F.col("_back") == 1) & (F.size("_x") == cfg.lookback * len(columns)))
            .select(*keys, date, "_lo0", "_hi0", F.concat(F.array(F.lit(1.0)), "_x").alias("_x"))
        )
        return readout(last, self.beta, keys, date)


def readout(last: DataFrame, beta: np.ndarray, keys: Sequence[str], date: str) -> DataFrame:
    """(keys, date, yhat) of the days after ``date``: the inputs ``_x`` times a column of ``beta`` for each day, unscaled."""
    table = ", ".join("array(" + ", ".join(f"{v!r}D" for v in column) + ")" for column in beta.T.tolist())
    steps = last.select("*", F.posexplode(F.expr(f"array({table})")).alias("_h", "_beta"))
    dot = F.aggregate(F.zip_with("_x", "_beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return steps.select(
        *keys,
        F.date_add(date, F.col("_h") + 1).alias(date),
        unscaled(dot, F.col("_lo0"), F.col("_hi0")).alias("yhat"),
    )


def ridge_path(
    sums: dict[bool, tuple[np.ndarray, ...]], penalties: Sequence[float], patience: int
) -> tuple[np.ndarray, list[tuple[int, float, float, float, bool]]]:
    """The best of the ridge fits by validation loss, and all that were tried.

    Penalties go from strong to weak until the validation loss has not improved ``patience`` times.
    """
    train = sums[True]
    valid = sums.get(False, train)
    best, best_loss, waited, tried = None, np.inf, 0, []
    for step, penalty in enumerate(penalties):
        ridge = np.eye(len(train[0])) * penalty
        ridge[0, 0] = 1e-9
        beta = np.linalg.solve(train[0] + ridge, train[1])
        loss = _loss(beta, valid)
        tried.append([step, penalty, _loss(beta, train), loss, False])
        if loss < best_loss:
            best, best_loss, waited = beta, loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    for entry in tried:
        entry[4] = entry[3] == best_loss
    return best, [tuple(e) for e in tried]


def fit_sequence(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    features: Sequence[str] = (),
    cfg: SequenceConfig = SequenceConfig(),
) -> SequenceModel | None:
    """Fit on the windows of the train rows; None when there are none.

    Penalties go from strong to weak until the validation loss has not improved
    ``patience`` times; the best fit is kept. ``keys=()`` takes the frame as one series.
    """
    panel = _scaled_panel(df, cfg, keys, date, target, features)
    columns = [f"_s{i}" for i in range(1 + len(features))]
    windows = supervised_windows(panel, cfg.lookback, cfg.horizon, keys, date, columns, part="is_train")
    width = cfg.lookback * len(columns)
    sums = _normal_equations(windows, width, cfg.horizon)
    if True not in sums:
        return None
    best, history = ridge_path(sums, cfg.penalties, cfg.patience)
    return SequenceModel(best, history, cfg, tuple(keys), tuple(features))
