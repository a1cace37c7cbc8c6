"""Weighted combination of model predictions.

Predictions are long: (keys, date, model, y, yhat, lower, upper).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast import DATE, KEYS

MODELS = ("additive", "sequence", "boosted")
Z95 = 1.96


def equal_weights(models: Sequence[str] = MODELS) -> dict[str, float]:
    return {m: 1.0 / len(models) for m in models}


def _weight(weights: Mapping[str, float] | DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach ``_w``; null for a model without a weight."""
    if isinstance(weights, DataFrame):
        listed = weights.select(*by, F.explode("weights").alias("model", "_w"))
        return rows.join(listed, [*by, "model"], "left")
    if not weights:
        return rows.withColumn("_w", F.lit(None).cast("double"))
    pairs = [F.lit(v) for m, w in weights.items() for v in (m, float(w))]
    return rows.withColumn("_w", F.try_element_at(F.create_map(*pairs), F.col("model")))


def _mean(column: str) -> Column:
    """Weighted mean normalised by the weight of the values present; 0 without weight, null if models with a
    weight have no value."""
    known = F.col("_w").isNotNull() & F.col(column).isNotNull()
    total, weight = F.sum(F.when(known, F.col("_w") * F.col(column))), F.sum(F.when(known, F.col("_w")))
    empty = weight.isNull() & (F.count("_w") > 0)
    return F.coalesce(F.try_divide(total, weight), F.when(~empty, F.lit(0.0)))


def ensemble_predict(
    predictions: DataFrame,
    weights: Mapping[str, float] | DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weighted mean per forecast row with bounds.

    With ``lower`` and ``upper`` columns the bounds are weighted like the forecast;
    otherwise they are 1.96 population deviations of all the models' forecasts.
    ``weights`` is a mapping, or a table (by..., weights map) as from ``optimize_weights``.
    """
    row = [*keys, *[c for c in ("window_id",) if c in predictions.columns and c not in keys], date]
    weighted = _weight(weights, predictions, by)
    aggs = [_mean("yhat").alias("yhat")]
    if "y" in predictions.columns:
        aggs.append(F.max("y").alias("y"))
    if {"lower", "upper"} <= set(predictions.columns):
        return weighted.groupBy(*row).agg(*aggs, _mean("lower").alias("lower"), _mean("upper").alias("upper"))
    out = weighted.groupBy(*row).agg(*aggs, F.stddev_pop("yhat").alias("_std"))
    width = F.lit(Z95) * F.col("_std")
    return out.withColumns({"lower": F.col("yhat") - width, "upper": F.col("yhat") + width}).drop("_std")


def gram_sums(
    predictions: DataFrame,
    models: Sequence[str] = MODELS,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sums of products of the models' forecasts with each other and with the truth.

    Rows that lack one of the forecasts or the truth are left out. One row per group, with
    arrays ``pp`` (upper triangle, row by row) and ``py``, and ``yy`` and ``n``.
    """
    row = [*keys, *[c for c in ("window_id",) if c in predictions.columns and c not in keys], date]
    wide = predictions.groupBy(*dict.fromkeys([*by, *row])).agg(
        F.max("y").alias("_y"),
        *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(f"_p{i}") for i, m in enumerate(models)],
    ).dropna(subset=["_y", *[f"_p{i}" for i in range(len(models))]])
    p = [F.col(f"_p{i}") for i in range(len(models))]
    pp = [F.sum(p[i] * p[j]) for i in range(len(p)) for j in range(i, len(p))]
    return wide.groupBy(*by).agg(
        F.array(*pp).alias("pp"),
        F.array(*[F.sum(c * F.col("_y")) for c in p]).alias("py"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
        F.count(F.lit(1)).alias("n"),
    )


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray | None:
    """Non-negative weights of sum 1 with the least squared error, by an active-set method.

    It starts at the best single model. On the models in use the optimum of the equality-constrained problem is linear; a
    step towards it ends where a weight reaches 0, and that model leaves. At the optimum of the models in use the one outside
    that lowers the error fastest enters. The error never rises, so no set of models returns.
    """
    m = len(cross)
    if not (np.isfinite(gram).all() and np.isfinite(cross).all()):
        return None
    scale = max(float(np.abs(gram).max()), 1e-12)
    gram, cross = gram / scale, cross / scale
    w = np.zeros(m)
    w[int(np.argmin(np.diag(gram) - 2 * cross))] = 1.0
    used = w > 0
    for _ in range(50 * m):
        s = np.flatnonzero(used)
        system = np.zeros((len(s) + 1, len(s) + 1))
        system[:-1, :-1] = gram[np.ix_(s, s)]
        system[:-1, -1] = system[-1, :-1] = 1.0
        # the change of the weights, so that of equal optima the nearest is taken
        move = np.linalg.lstsq(system, np.append(cross[s] - gram[s] @ w, 0.0), rcond=1e-12)[0][:-1]
        down = move < 0
        reach = w[s][down] / -move[down]
        if len(reach) and reach.min() < 1 - 1e-12:
            leaving = s[down][int(np.argmin(reach))]
            w[s] = np.maximum(w[s] + reach.min() * move, 0.0)
            w[leaving], used[leaving] = 0.0, False
            continue
        w[s] = np.maximum(w[s] + move, 0.0)
        slope = gram @ w - cross
        level = float(slope @ w) / float(w.sum())
        outside = np.where(used, np.inf, slope - level)
        enter = int(np.argmin(outside))
        if not outside[enter] < -1e-11:
            break
        used[enter] = True
    return w / w.sum()


def optimize_weights(
    predictions: DataFrame,
    models: Sequence[str] = MODELS,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    by: Sequence[str] = (),
    previous: Mapping[str, float] | None = None,
) -> DataFrame:
    """Weights with the least RMSE on the given truth: (by..., weights map, rmse, n).

    The rows are reduced to sums of products by one distributed aggregate; a task then
    solves a problem of the size of the model list. Where it has no solution the
    ``previous`` weights (equal ones by default) stay.
    """
    names = list(models)
    fallback = np.array([(previous or equal_weights(names)).get(m, 0.0) for m in names])
    upper = np.triu_indices(len(names))
    sums = gram_sums(predictions, names, keys, date, by)
    schema = T.StructType(
        [
            *[sums.schema[k] for k in by],
            T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("rmse", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                w, rmse = fallback, None
                if row["n"]:
                    gram = np.zeros((len(names), len(names)))
                    gram[upper] = row["pp"]
                    gram = gram + np.triu(gram, 1).T
                    cross = np.asarray(row["py"], dtype=float)
                    found = simplex_weights(gram, cross)
                    w = fallback if found is None else found
                    rmse = float(np.sqrt(max(w @ gram @ w - 2 * w @ cross + row["yy"], 0.0) / row["n"]))
                out.append(
                    {**{k: row[k] for k in by}, "weights": dict(zip(names, map(float, w), strict=True)), "rmse": rmse, "n": row["n"]}
                )
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return sums.mapInPandas(solve, schema)
