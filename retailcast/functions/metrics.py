"""Forecast error measures as aggregate expressions. Rows with a null are skipped."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

METRICS = ("mape", "rmse", "mae", "smape")


def _scored(y: str, yhat: str) -> Column:
    return F.col(y).isNotNull() & F.col(yhat).isNotNull()


def _or_zero(mean: Column, y: str, yhat: str) -> Column:
    """0 when every scored row has a zero denominator; null when no row was scored."""
    return F.when(F.count_if(_scored(y, yhat)) > 0, F.coalesce(mean * 100, F.lit(0.0)))


def mape(y: str, yhat: str) -> Column:
    """Mean absolute percentage error over rows with y != 0; 0 when all scored rows have y = 0."""
    share = F.when(F.col(y) != 0, F.abs(F.try_divide(F.col(y) - F.col(yhat), F.col(y))))
    return _or_zero(F.avg(share), y, yhat)


def rmse(y: str, yhat: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat))))


def mae(y: str, yhat: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(yhat)))


def smape(y: str, yhat: str) -> Column:
    """Symmetric percentage error over rows whose mean magnitude is not 0; 0 when no scored row has one."""
    size = (F.abs(F.col(y)) + F.abs(F.col(yhat))) / 2
    share = F.when(size != 0, F.try_divide(F.abs(F.col(y) - F.col(yhat)), size))
    return _or_zero(F.avg(share), y, yhat)


def all_metrics(y: str = "y", yhat: str = "yhat") -> list[Column]:
    """The four measures, the number of scored rows and of rows skipped for a null."""
    scored = _scored(y, yhat)
    return [
        mape(y, yhat).alias("mape"),
        rmse(y, yhat).alias("rmse"),
        mae(y, yhat).alias("mae"),
        smape(y, yhat).alias("smape"),
        F.count_if(scored).alias("n_scored"),
        F.count_if(~scored).alias("n_null"),
    ]


@F.pandas_udf(DoubleType())
def two_sided_p(statistic: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    tail = np.vectorize(lambda z: math.erfc(abs(z) / math.sqrt(2.0)), otypes=[float])
    return pd.Series(tail(statistic.to_numpy(dtype=float))) if len(statistic) else pd.Series([], dtype=float)
