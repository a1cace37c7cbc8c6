"""Model features: lags, rolling statistics, calendar, holidays, promotion, oil price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast import DATE, KEYS, TARGET
from retailcast.operators.joins import join_per_date, lookup_join
from retailcast.operators.ordered import filled, global_lag, ordered_scan
from retailcast.operators.panel import known_series, require_daily_grain, series_window

LAGS = (7, 14, 28, 365)
WINDOWS = (7, 28)


def lag_columns(keys: Sequence[str], date: str, target: str, lags: Sequence[int]) -> dict[str, Column]:
    w = series_window(keys, date)
    return {f"{target}_lag_{k}": F.when(known_series(keys), F.lag(target, k).over(w)) for k in lags}


def rolling_columns(keys: Sequence[str], date: str, target: str, windows: Sequence[int]) -> dict[str, Column]:
    out = {}
    for size in windows:
        w = series_window(keys, date).rowsBetween(-size, -1)
        for name, stat in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{target}_rolling_{name}_{size}"] = F.when(known_series(keys), stat(target).over(w))
    return out


def add_lag_features(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    lags: Sequence[int] = LAGS,
) -> DataFrame:
    """Target value ``k`` rows earlier in the series (densify first for calendar lags)."""
    return df.withColumns(lag_columns(keys, date, target, lags))


def add_rolling_features(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """Mean, sample std, min and max of the previous rows, the current one left out."""
    return df.withColumns(rolling_columns(keys, date, target, windows))


def add_series_features(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """Lags and rolling statistics together: one exchange and one sort for all of them."""
    return df.withColumns(
        lag_columns(keys, date, target, lags) | rolling_columns(keys, date, target, windows)
    )


def add_temporal_features(df: DataFrame, date: str = DATE) -> DataFrame:
    """Calendar parts of the date; Monday is 0, weeks are ISO weeks."""
    d = F.expr(f"try_cast(`{date}` AS date)")
    flag = lambda c: c.cast("int")
    return df.withColumns(
        {
            date: d,
            "day_of_week": F.weekday(d),
            "day_of_month": F.day(d),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "year": F.year(d),
            "week_of_year": F.weekofyear(d),
            "is_weekend": flag(F.weekday(d) >= 5),
            "is_month_start": flag(F.day(d) == 1),
            "is_month_end": flag(d == F.last_day(d)),
        }
    )


def days_to_payday(date: str = DATE) -> Column:
    """Distance to the 15th or to the last day of the month, whichever is nearer."""
    day = F.day(date)
    return F.least(F.abs(day - 15), F.abs(day - F.day(F.last_day(date))))


def holiday_column(kind: str) -> str:
    return "is_holiday_" + kind.lower().replace(" ", "_")


def add_holiday_features(
    df: DataFrame,
    date: str = DATE,
    holidays: DataFrame | None = None,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """A 0/1 column per holiday type, and the days to the next or last payday.

    The types become columns, so they have to be known when the plan is made: pass
    ``types``, or they are read from the holiday table with one small job.
    """
    out = df
    if holidays is not None:
        days = holidays.select(F.expr(f"try_cast(`{DATE}` AS date)").alias(date), "type")
        if types is None:
            types = [r["type"] for r in days.select("type").distinct().orderBy("type").collect()]
        flags = {holiday_column(str(t)): F.max((F.col("type").eqNullSafe(F.lit(t))).cast("int")) for t in types}
        if flags:
            per_day = days.groupBy(date).agg(*[c.alias(n) for n, c in flags.items()])
            out = join_per_date(out, per_day, date).withColumns(
                {n: F.coalesce(F.col(n), F.lit(0)) for n in flags}
            )
    return out.withColumn("days_to_payday", days_to_payday(date))


def add_promotion_features(df: DataFrame) -> DataFrame:
    """Promotion count as a whole number, 0 where unknown; no-op without the column."""
    if "onpromotion" not in df.columns:
        return df
    known = F.coalesce(F.col("onpromotion"), F.lit(0))
    return df.withColumn("onpromotion", known.cast("int"))


def _change(price: Column, earlier: Column) -> Column:
    return F.try_divide(price, earlier) - 1


def oil_by_date(df: DataFrame, date: str = DATE, lag: int = 7) -> DataFrame:
    """Filled price, lag and change per date of the frame.

    The window has no partitions but runs over one row per date only, a number
    bounded by the calendar.
    """
    w = Window.orderBy(date)
    per_day = df.where(F.col(date).isNotNull()).groupBy(date).agg(F.max("dcoilwtico").alias("_price"))
    price = F.last("_price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    table = per_day.select(date, price.alias("oil_price"))
    table = table.withColumn("oil_price_lag_7", F.lag("oil_price", lag).over(w))
    return table.withColumn("oil_price_change", _change(F.col("oil_price"), F.col("oil_price_lag_7")))


def add_oil_features(
    df: DataFrame,
    by: str = "date",
    date: str = DATE,
    order_by: Sequence[str] = (DATE, *KEYS),
    oil_days: DataFrame | None = None,
) -> DataFrame:
    """Forward-filled oil price, its lag 7 and its change over 7.

    ``by="date"`` steps over dates (``oil_days`` may pass the output of
    ``oil_by_date`` computed earlier); ``by="row"`` steps over rows in the global
    order, so with many rows per date the lag is mostly of the same day.
    """
    if "dcoilwtico" not in df.columns:
        return df
    if by == "date":
        return join_per_date(df, oil_by_date(df, date) if oil_days is None else oil_days, date)
    if by != "row":
        raise ValueError(f"unknown step: {by}")
    numbered = ordered_scan(df, order_by, "dcoilwtico").withColumn("oil_price", filled("dcoilwtico"))
    lagged = global_lag(numbered.drop("prev", "next"), "oil_price", 7, "oil_price_lag_7")
    return lagged.withColumn(
        "oil_price_change", _change(F.col("oil_price"), F.col("oil_price_lag_7"))
    ).drop("pos")


def engineer_all_features(
    df: DataFrame,
    holidays: DataFrame | None = None,
    holiday_types: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    target: str = TARGET,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    oil_by: str = "date",
) -> DataFrame:
    """All features; the number of rows stays. The series are shuffled once.

    The oil table is taken from the input, before the windows, so that computing it
    reads two columns of the input and not the whole feature plan a second time.
    """
    dated = df.withColumn(date, F.expr(f"try_cast(`{date}` AS date)"))
    oil_days = oil_by_date(dated, date) if "dcoilwtico" in df.columns and oil_by == "date" else None
    out = require_daily_grain(dated, keys, date)
    out = add_series_features(out, keys, date, target, lags, windows)
    out = add_temporal_features(out, date)
    out = add_holiday_features(out, date, holidays, holiday_types)
    out = add_promotion_features(out)
    return add_oil_features(out, oil_by, date, (date, *keys), oil_days)


def future_values(frame: DataFrame, values: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach known future values of regressors by date (and key)."""
    return lookup_join(frame, values, on)


NOT_FEATURES = ("date", "id", "store_nbr", "family")
NUMERIC = ("int", "bigint", "float", "double")


def feature_columns(df: DataFrame, target: str = TARGET, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that may serve as features, sorted."""
    left_out = {target, *exclude, *NOT_FEATURES}
    return sorted(n for n, t in df.dtypes if t in NUMERIC and n not in left_out)


# largest finite float64, the value an infinite feature is replaced with
MAX_DOUBLE = 1.7976931348623157e308


def finite(column: str) -> Column:
    """Null and NaN to 0, infinities to the largest finite double."""
    c = F.col(column).cast("double")
    known = F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(known, F.lit(-MAX_DOUBLE)), F.lit(MAX_DOUBLE))


def scale_bounds(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Minimum and maximum of each column per series (``{c}_min``, ``{c}_max``)."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*aggs)


def scaled(column: Column, low: Column, high: Column) -> Column:
    return (column - low) / (high - low + F.lit(1e-8))


def unscaled(column: Column, low: Column, high: Column) -> Column:
    return column * (high - low) + low


def min_max_scale(
    df: DataFrame,
    columns: Sequence[str] = (TARGET,),
    keys: Sequence[str] = KEYS,
    fit_on: Column | None = None,
) -> DataFrame:
    """Add ``{c}_scaled`` with bounds per series, taken from the rows ``fit_on`` selects."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in columns:
        seen = F.col(c) if fit_on is None else F.when(fit_on, F.col(c))
        out[f"{c}_scaled"] = scaled(F.col(c), F.min(seen).over(w), F.max(seen).over(w))
    return df.withColumns(out)
