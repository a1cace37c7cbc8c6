"""Boosted trees for every series on its own: second-order histogram boosting with patience.

A series holds at most one row per day, so its rows fit one task, and the series of all keys are fitted in parallel by
one exchange. A split is scored by the second-order gain with L1 and L2 terms; rows and columns of a tree are sampled by hashes,
so a fit does not depend on the order of tasks. Boosting ends when the validation error has not fallen for ``patience`` rounds
and returns to the best round; without patience all rounds are kept.

Models are rows of a table: trees are arrays in heap order (children of node i are 2i+1 and 2i+2), next to the feature names
and the configuration, so that a stored table can be read and scored with nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailcast import DATE, KEYS, TARGET
from retailcast.models.boosted import BoostedConfig
from retailcast.operators.features import LAGS, MAX_DOUBLE, WINDOWS, engineer_all_features, feature_columns, finite
from retailcast.operators.panel import future_calendar, min_group_size, series_split
from retailcast.session import scratch_path

FITTED = (
    "rows long, base double, best_round int, names array<string>, config string, feature array<array<int>>, "
    "threshold array<array<double>>, value array<array<double>>, gain array<double>, train_rmse array<double>, valid_rmse array<double>"
)


def drawn(ids: np.ndarray, salt: int, share: float) -> np.ndarray:
    """A mask of about ``share`` of the ids, the same wherever it is drawn."""
    h = (ids.astype(np.uint64) + np.uint64(salt % (1 << 63))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    """Values that may split a feature: all but the largest, or those at even ranks if there are more than ``bins``."""
    values = np.unique(column)
    if len(values) > bins:
        ordered = np.sort(column)
        values = np.append(np.unique(ordered[np.arange(1, bins) * len(ordered) // bins]), values[-1:])
        values = np.unique(values)
    return values[:-1]


def score(g: np.ndarray, h: np.ndarray, alpha: float, reg: float) -> np.ndarray:
    """Gain of a leaf with gradient and hessian sums ``g`` and ``h``."""
    kept = np.maximum(np.abs(g) - alpha, 0)
    return np.divide(kept * kept, h + reg, out=np.zeros_like(kept), where=h + reg > 0)


@dataclass
class Tree:
    feature: np.ndarray  # of each node in heap order, -1 for a leaf
    threshold: np.ndarray  # rows at or below it go left
    value: np.ndarray
    gain: np.ndarray  # by feature

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range((len(self.feature) + 1).bit_length() - 2):
            at = self.feature[node]
            right = x[np.arange(len(x)), at] > self.threshold[node]
            node = np.where(at >= 0, 2 * node + 1 + right, node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


def grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray, cfg: BoostedConfig) -> Tree:
    """A tree level by level; the split of a node is the best over all bins of the chosen columns, the first one on ties."""
    n_features, bins = binned.shape[1], max((len(c) for c in cuts), default=0) + 1
    size = 2 ** (cfg.max_depth + 1) - 1
    feature, threshold, gains = np.full(size, -1), np.zeros(size), np.zeros(n_features)
    node = np.zeros(len(binned), np.int64)
    allowed = columns[:, None] & (np.arange(bins) < np.array([len(c) for c in cuts])[:, None])
    place = np.arange(n_features) * bins + binned
    for depth in range(cfg.max_depth):
        first, width = 2**depth - 1, 2**depth
        here = np.flatnonzero(node >= first)
        if not len(here) or not allowed.any():
            break
        at = ((node[here] - first)[:, None] * (n_features * bins) + place[here]).ravel()
        sums = [
            np.bincount(at, np.repeat(w[here], n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(2)
            for w in (g, h)
        ]
        (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
        alpha, reg = cfg.reg_alpha, cfg.reg_lambda
        gain = score(gl, hl, alpha, reg) + score(gt - gl, ht - hl, alpha, reg) - score(gt, ht, alpha, reg)
        usable = allowed & (hl >= cfg.min_child_rows) & (ht - hl >= cfg.min_child_rows)
        gain = np.where(usable, gain, -np.inf).reshape(width, -1)
        best = gain.argmax(1)
        top = gain[np.arange(width), best]
        split = np.flatnonzero(top > 1e-9)
        for k in split:
            f, b = divmod(int(best[k]), bins)
            feature[first + k], threshold[first + k] = f, cuts[f][b]
            gains[f] += top[k]
        chosen = np.full(width, -1)
        chosen[split] = best[split]
        mine = chosen[node[here] - first]
        moved = here[mine >= 0]
        f, b = np.divmod(mine[mine >= 0], bins)
        node[moved] = 2 * node[moved] + 1 + (binned[moved, f] > b)
    total = [np.bincount(node, w, size) for w in (g, h)]
    kept = np.sign(total[0]) * np.maximum(np.abs(total[0]) - cfg.reg_alpha, 0)
    value = -cfg.learning_rate * np.divide(kept, total[1] + cfg.reg_lambda, out=np.zeros(size), where=total[1] > 0)
    return Tree(feature, threshold, value, gains)


def rmse(error: np.ndarray) -> float:
    return float(np.sqrt(np.mean(error * error))) if len(error) else float("nan")


def boost(
    x: np.ndarray, y: np.ndarray, x_valid: np.ndarray, y_valid: np.ndarray, cfg: BoostedConfig
) -> tuple[float, list[Tree], list[tuple[float, float]]]:
    """Base value, trees up to the best round, and (training, validation) RMSE of every round run."""
    cuts = [cut_points(x[:, f], cfg.bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1) if cuts else np.zeros((len(x), 0), int)
    base = float(y.mean())
    fitted, valid = np.full(len(y), base), np.full(len(y_valid), base)
    trees: list[Tree] = []
    history: list[tuple[float, float]] = []
    best, best_error = 0, np.inf
    for k in range(cfg.n_estimators):
        rows = drawn(np.arange(len(y)), cfg.seed * 1_000_003 + 2 * k, cfg.subsample).astype(float)
        columns = drawn(np.arange(x.shape[1]), cfg.seed * 1_000_003 + 2 * k + 1, cfg.colsample)
        tree = grow(binned, cuts, (fitted - y) * rows, rows, columns, cfg)
        trees.append(tree)
        fitted += tree.predict(x)
        valid += tree.predict(x_valid)
        history.append((rmse(fitted - y), rmse(valid - y_valid)))
        if cfg.patience is None or not len(y_valid):
            best = k + 1
        elif history[-1][1] < best_error:
            best, best_error = k + 1, history[-1][1]
        elif k + 1 - best >= cfg.patience:
            break
    return base, trees[:best], history


def _trees(row) -> list[Tree]:
    nothing = np.zeros(0)
    parts = zip(row["feature"], row["threshold"], row["value"], strict=True)
    return [Tree(np.array(f, int), np.array(t, float), np.array(v, float), nothing) for f, t, v in parts]


def _scored(row, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return row["base"] + sum((t.predict(x) for t in trees), np.zeros(len(x)))


@dataclass
class SeriesBoosters:
    """One fitted model a series: a table with the columns of ``FITTED`` and the keys."""

    models: DataFrame
    keys: Sequence[str] = KEYS

    @property
    def names(self) -> list[str]:
        first = self.models.select("names").first()
        return list(first["names"]) if first else []

    def predict(self, df: DataFrame, date: str = DATE) -> DataFrame:
        """(date, keys, prediction) for the rows of trained series; empty when there are none."""
        names, keys = self.names, list(self.keys)
        schema = df.select(date, *keys).withColumn("prediction", F.lit(0.0)).schema
        if not names:
            return df.sparkSession.createDataFrame([], schema)

        def run(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
            if not len(models) or not len(rows):
                return rows[[date, *keys]].iloc[:0].assign(prediction=0.0)
            row = models.iloc[0]
            return rows[[date, *keys]].assign(prediction=_scored(row, _trees(row), rows[names].to_numpy(np.float64)))

        inputs = df.select(date, *keys, *[finite(n).alias(n) for n in names])
        return inputs.groupBy(*keys).cogroup(self.models.groupBy(*keys)).applyInPandas(run, schema)

    def rounds(self) -> DataFrame:
        """(keys, round, train_rmse, valid_rmse, best) of every round run."""
        flat = self.models.select(*self.keys, "best_round", F.posexplode(F.arrays_zip("train_rmse", "valid_rmse")).alias("at", "e"))
        kept = F.col("at") + 1
        return flat.select(*self.keys, kept.alias("round"), "e.train_rmse", "e.valid_rmse", (kept == F.col("best_round")).alias("best"))

    def importances(self) -> DataFrame:
        """(feature, importance): share of the gain, the mean over the series that have splits."""
        total = F.aggregate("gain", F.lit(0.0), lambda a, b: a + b)
        shares = self.models.where(total > 0).select(F.explode(F.arrays_zip("names", F.transform("gain", lambda g: g / total).alias("share"))).alias("s"))
        return shares.groupBy(F.col("s.names").alias("feature")).agg(F.avg("s.share").alias("importance"))

    def top_features(self, n: int = 20) -> DataFrame:
        return self.importances().orderBy(F.col("importance").desc(), "feature").limit(n)

    def save(self, path: str) -> None:
        self.models.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, keys: Sequence[str] = KEYS) -> SeriesBoosters:
        """All that scoring needs is in the table."""
        return cls(SparkSession.active().read.parquet(path), keys)

    def roll_forward(
        self,
        panel: DataFrame,
        horizon: int,
        holidays: DataFrame | None = None,
        future: DataFrame | None = None,
        date: str = DATE,
        target: str = TARGET,
        lags: Sequence[int] = LAGS,
        windows: Sequence[int] = WINDOWS,
    ) -> DataFrame:
        """(keys, date, yhat) of the ``horizon`` days after the last one of each trained series.

        The days are appended to the panel and get its features; ``future`` may give (keys, date) regressors known ahead. Lags and rolling statistics of
        later days rest on the predictions of the days before, kept in a buffer per series. Promotions default to 0, other
        columns to their last value.
        """
        names, keys = self.names, list(self.keys)
        schema = panel.select(*keys, date).withColumn("yhat", F.lit(0.0)).schema
        if not names:
            return panel.sparkSession.createDataFrame([], schema)
        days = future_calendar(panel, horizon, keys, date)
        if future is not None:
            days = days.join(future, [*keys, date], "left")
        if "onpromotion" in panel.columns:
            days = days.withColumn("onpromotion", F.coalesce("onpromotion", F.lit(0)) if "onpromotion" in days.columns else F.lit(0))
        both = panel.withColumn("_future", F.lit(0)).unionByName(days.withColumn("_future", F.lit(1)), allowMissingColumns=True)
        carried = [c for c in panel.columns if c not in (*keys, date, target, "onpromotion", "dcoilwtico")]
        earlier = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({c: F.when(F.col("_future") == 1, F.last(c, True).over(earlier)).otherwise(F.col(c)) for c in carried})
        frame = engineer_all_features(both, holidays, None, keys, date, target, lags, windows)
        inputs = frame.select(*keys, date, "_future", F.col(target).cast("double").alias("_y"), *[finite(n).alias(n) for n in names])

        def run(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
            if not len(models) or not len(rows):
                return rows[[*keys, date]].iloc[:0].assign(yhat=0.0)
            row, rows = models.iloc[0], rows.sort_values(date, kind="stable")
            trees, ahead = _trees(row), rows[rows["_future"] == 1]
            known = rows.loc[rows["_future"] == 0, "_y"].to_numpy(np.float64)
            x, yhat = ahead[names].to_numpy(np.float64), []
            buffer = np.concatenate([known, np.full(len(ahead), np.nan)])
            for step in range(len(ahead)):
                at = len(known) + step
                fresh = series_features(buffer[:at], target, lags, windows)
                for c, v in fresh.items():
                    if c in places:
                        x[step, places[c]] = v
                buffer[at] = _scored(row, trees, x[step : step + 1])[0]
                yhat.append(buffer[at])
            return ahead[[*keys, date]].assign(yhat=np.array(yhat, float))

        places = {n: i for i, n in enumerate(names)}
        return inputs.groupBy(*keys).cogroup(self.models.groupBy(*keys)).applyInPandas(run, schema)


def series_features(values: np.ndarray, target: str, lags: Sequence[int], windows: Sequence[int]) -> dict[str, float]:
    """Lags and rolling statistics of the day after ``values``; unknown ones are 0, as a model reads them."""
    out = {}
    for k in lags:
        out[f"{target}_lag_{k}"] = values[-k] if len(values) >= k else np.nan
    for size in windows:
        held = values[-size:]
        held = held[~np.isnan(held)]
        stats = (held.mean(), held.std(ddof=1) if len(held) > 1 else np.nan, held.min(), held.max()) if len(held) else (np.nan,) * 4
        for name, v in zip(("mean", "std", "min", "max"), stats, strict=True):
            out[f"{target}_rolling_{name}_{size}"] = v
    return {c: float(np.clip(np.nan_to_num(v, nan=0.0, posinf=MAX_DOUBLE, neginf=-MAX_DOUBLE), -MAX_DOUBLE, MAX_DOUBLE)) for c, v in out.items()}


def fit_series_boosters(
    df: DataFrame,
    target: str = TARGET,
    exclude: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    min_rows: int = 100,
    cfg: BoostedConfig = BoostedConfig(),
) -> SeriesBoosters:
    """A model for every series of at least ``min_rows`` known rows: the first 80 % trains, the last 20 % stops the boosting."""
    names, keys = feature_columns(df, target, exclude), list(keys)
    known = df.where(F.col(target).isNotNull())
    split = series_split(min_group_size(known, keys, min_rows), keys, date)
    rows = split.select(*keys, date, F.col(target).cast("double").alias("_y"), "is_train", *[finite(n).alias(n) for n in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable")
        train = pdf["is_train"].to_numpy(bool)
        x, y = pdf[names].to_numpy(np.float64), pdf["_y"].to_numpy(np.float64)
        base, trees, history = boost(x[train], y[train], x[~train], y[~train], cfg)
        out = {k: pdf[k].iloc[:1].tolist() for k in keys}
        out |= {"rows": [int(train.sum())], "base": [base], "best_round": [len(trees)], "names": [names], "config": [settings]}
        out |= {part: [[getattr(t, part).tolist() for t in trees]] for part in ("feature", "threshold", "value")}
        out["gain"] = [sum((t.gain for t in trees), np.zeros(len(names))).tolist()]
        out |= {"train_rmse": [[h[0] for h in history]], "valid_rmse": [[h[1] for h in history]]}
        return pd.DataFrame(out)

    settings = json.dumps(asdict(cfg))
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", " + FITTED
    path = scratch_path(df.sparkSession, "series-boosters")
    rows.groupBy(*keys).applyInPandas(run, schema).write.parquet(path)
    return SeriesBoosters.load(path, keys)
