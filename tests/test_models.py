import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import column, day, series
from retailcast.config import BacktestConfig
from retailcast.models import additive, boosted, sequence
from retailcast.operators import backtest, features

SMALL = additive.AdditiveConfig(yearly_order=0, n_changepoints=5)


def trend_wave(n):
    return [100 + 10 * (i % 7) + 0.5 * i for i in range(n)]


@pytest.fixture(scope="module")
def two_series(spark):
    both = series(spark, trend_wave(90)).union(series(spark, [5.0] * 60, store=2, family="B"))
    return both.cache()


def test_prepare_drops_nulls_and_keeps_regressors_with_their_rows(spark):
    rows = [(day(0), 1, "A", None, 7.0), (day(1), 1, "A", 2.0, 8.0)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, r double")
    out = additive.prepare(df, regressors=("r",)).collect()
    assert [(r["ds"], r["y"], r["r"]) for r in out] == [(day(1), 2.0, 8.0)]


def test_holiday_windows_reach_one_day_around(spark):
    holidays = spark.createDataFrame([(dt.date(2023, 1, 1), "New Year")], "date date, description string")
    out = additive.holiday_windows(holidays).orderBy("date").collect()
    assert [(r["date"], r["offset"]) for r in out] == [(dt.date(2022, 12, 31), -1), (dt.date(2023, 1, 1), 0), (dt.date(2023, 1, 2), 1)]


def test_additive_forecast_continues_trend_and_week(two_series):
    fitted = additive.fit_additive(two_series, cfg=SMALL).cache()
    out = additive.predict_additive(fitted, 14, cfg=SMALL)
    first = [r for r in out.orderBy("ds").collect() if r["store_nbr"] == 1]
    assert [r["ds"] for r in first] == [day(90 + i) for i in range(14)]
    assert [r["yhat"] for r in first] == pytest.approx(trend_wave(104)[90:], abs=6)
    assert all(r["lower"] <= r["yhat"] <= r["upper"] for r in first)
    width = [r["upper"] - r["lower"] for r in first]
    assert width[-1] >= width[0]
    flat = [r["yhat"] for r in out.where("store_nbr = 2").collect()]
    assert flat == pytest.approx([5.0] * 14, abs=0.5)


def test_additive_history_and_horizon(two_series):
    fitted = additive.fit_additive(two_series, cfg=SMALL).cache()
    out = additive.predict_additive(fitted, 7, history=two_series, cfg=SMALL)
    assert out.groupBy("store_nbr").count().orderBy("store_nbr").collect()[0]["count"] == 97


def test_additive_learns_holidays_and_regressors(spark):
    n = 120
    bumps = {20, 60, 100, 125}
    promo = [float(i % 3 == 0) for i in range(n + 10)]
    values = [50 + 5 * promo[i] + (30 if i in bumps else 0) for i in range(n)]
    df = series(spark, values).withColumn("promo", (F.date_diff("date", F.lit(day(0))) % 3 == 0).cast("double"))
    holidays = spark.createDataFrame([(day(i), "Fair") for i in sorted(bumps)], "date date, description string")
    future = spark.createDataFrame([(day(n + i), promo[n + i]) for i in range(10)], "date date, promo double")
    fitted = additive.fit_additive(df, holidays=holidays, regressors=("promo",), cfg=SMALL).cache()
    out = additive.predict_additive(
        fitted, 10, holidays=holidays, future_regressors=future, regressors=("promo",), cfg=SMALL
    )
    got = [r["yhat"] for r in out.orderBy("ds").collect()]
    want = [50 + 5 * promo[n + i] + (30 if n + i in bumps else 0) for i in range(10)]
    assert got == pytest.approx(want, abs=2.5)


def test_additive_skips_series_of_one_row(spark):
    assert additive.fit_additive(series(spark, [3.0]), cfg=SMALL).count() == 0


def test_additive_beats_the_last_value_in_a_backtest(spark):
    from retailcast.config import BacktestConfig
    from retailcast.operators import backtest

    rng = np.random.default_rng(0)
    values = 100 + 20 * np.sin(2 * np.pi * np.arange(200) / 7) + rng.normal(0, 2, 200)
    cfg = BacktestConfig(train_window_months=4, test_window_days=14, step_days=14, min_train_samples=60)
    df = series(spark, values)
    model = additive.backtest_model(cfg=SMALL)
    predicted = backtest.model_predictions(df, {"additive": model}, cfg=cfg)
    assert predicted.where("error is not null or yhat < 0").count() == 0
    ours = backtest.window_metrics(predicted).agg(F.avg("rmse")).first()[0]
    naive = backtest.window_metrics(backtest.baseline_predictions(df, cfg=cfg)).where("model = 'naive'")
    assert ours < naive.agg(F.avg("rmse")).first()[0] / 2


def test_windows_from_running_sums_equal_refits_on_the_same_basis(spark):
    """Every window's forecast equals a fit on the products of its own training rows."""
    rng = np.random.default_rng(6)
    values = [None if i % 97 == 5 else 80 + i / 9 + 15 * np.sin(2 * np.pi * i / 7) + rng.normal() for i in range(520)]
    both = series(spark, values).union(series(spark, [None if v is None else 3 * v for v in values[:400]], store=2, skip=(30, 31, 390)))
    windows = BacktestConfig(step_days=20)
    got = additive.window_predictions(both, windows=windows).toPandas()
    cfg = additive.AdditiveConfig()
    want = backtest.model_predictions(both, {"m": lambda train, test: np.zeros(len(test))}, cfg=windows).toPandas()
    assert len(got) == len(want) and set(zip(got["store_nbr"], got["window_id"])) == set(zip(want["store_nbr"], want["window_id"]))
    for store in (1, 2):
        rows = both.where(f"store_nbr = {store}").orderBy("date").toPandas()
        days = pd.to_datetime(rows["date"]).to_numpy("datetime64[D]").astype(int)
        y = rows["sales"].to_numpy(float)
        x, knots = additive.window_basis(days, cfg)
        for window_id, part in got[got["store_nbr"] == store].groupby("window_id"):
            part = part.sort_values("date")
            at = np.searchsorted(days, pd.to_datetime(part["date"]).to_numpy("datetime64[D]").astype(int))
            end = at[0]
            active = int((knots <= 0.8 * (days[end - 1] - days[0]) / (days[-1] - days[0])).sum())
            chosen = [*range(2 + active), *range(2 + len(knots), x.shape[1])]
            fresh = np.flatnonzero(~np.isnan(y[:end]))
            z, scale = x[fresh][:, chosen], np.abs(y[fresh]).max()
            sums = z.T @ z, z.T @ (y[fresh] / scale), float((y[fresh] / scale) @ (y[fresh] / scale))
            beta, _ = additive.reweighted(*sums, len(fresh), additive.priors(active, 0, 0, cfg), active, cfg)
            plain = np.clip(x[at][:, chosen] @ beta * scale, 0, None)
            assert part["yhat"].to_numpy() == pytest.approx(plain, rel=1e-6, abs=1e-6)
            assert np.isnan(part["y"].to_numpy(float)).tolist() == np.isnan(y[at]).tolist()
    error = np.nanmean(np.abs(got["yhat"] - got["y"].astype(float)))
    assert error < 8
    assert additive.window_predictions(both.limit(0)).count() == 0


@pytest.fixture(scope="module")
def boosted_fit(spark):
    both = series(spark, trend_wave(150)).union(series(spark, trend_wave(150), store=2)).union(series(spark, [1] * 20, store=3))
    frame = features.add_temporal_features(features.add_series_features(both, lags=(7,), windows=(7,))).cache()
    cfg = boosted.BoostedConfig(n_estimators=10, max_depth=3, subsample=1.0, colsample=1.0)
    return frame, boosted.fit_boosted(frame, cfg=cfg)


def test_boosted_predicts_only_trained_series(boosted_fit):
    frame, model = boosted_fit
    out = model.predict(frame)
    assert out.columns == ["date", "store_nbr", "family", "prediction"]
    assert {r["store_nbr"] for r in out.select("store_nbr").distinct().collect()} == {1, 2}
    joined = out.join(frame, ["date", "store_nbr", "family"])
    assert joined.agg(F.avg(F.abs(F.col("prediction") - F.col("sales")))).first()[0] < 15


def test_importances_sum_to_one(boosted_fit):
    _, model = boosted_fit
    rows = model.top_features(100).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert model.top_features(2).count() == 2


def test_boosted_round_trip(boosted_fit, tmp_path):
    frame, model = boosted_fit
    model.save(str(tmp_path / "m"))
    again = boosted.BoostedModel.load(str(tmp_path / "m"))
    order = ("store_nbr", "family", "date")
    assert column(again.predict(frame), "prediction", order) == pytest.approx(column(model.predict(frame), "prediction", order))


def test_boosted_without_long_series(spark):
    assert boosted.fit_boosted(features.add_lag_features(series(spark, range(50)), lags=(7,))) is None


def test_supervised_windows_count_and_content(spark):
    out = sequence.supervised_windows(series(spark, range(20)), 5, 3).orderBy("date").collect()
    assert len(out) == 20 - 5 - 3 + 1
    assert (out[0]["x"], out[0]["y"]) == ([0, 1, 2, 3, 4], [5, 6, 7])


def test_supervised_windows_of_several_columns(spark):
    df = series(spark, range(6)).withColumn("f", F.col("sales") * 10)
    row = sequence.supervised_windows(df, 2, 1, columns=("sales", "f")).orderBy("date").first()
    assert (row["x"], row["y"]) == ([0, 0, 1, 10], [2])


def test_windows_do_not_cross_the_split(spark):
    df = series(spark, range(20)).withColumn("is_train", F.col("sales") < 12)
    assert sequence.supervised_windows(df, 4, 2, part="is_train").count() == (12 - 5) + (8 - 5)


def test_sequence_learns_a_week(spark):
    cfg = sequence.SequenceConfig(lookback=14, horizon=7, penalties=(1.0, 0.1, 0.01, 0.001))
    values = 100 + 20 * np.sin(2 * np.pi * np.arange(120) / 7)
    both = series(spark, values).union(series(spark, values * 3, store=2))
    model = sequence.fit_sequence(both, cfg=cfg)
    out = model.predict(both)
    want = 100 + 20 * np.sin(2 * np.pi * np.arange(120, 127) / 7)
    assert column(out.where("store_nbr = 1"), "yhat") == pytest.approx(want, abs=1)
    assert column(out.where("store_nbr = 2"), "yhat") == pytest.approx(want * 3, abs=3)
    losses = model.losses(spark).collect()
    assert sum(r["best"] for r in losses) == 1
    assert min(r["val_loss"] for r in losses) == [r["val_loss"] for r in losses if r["best"]][0]


def test_sequence_equals_direct_least_squares(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(10, 2, 60)
    cfg = sequence.SequenceConfig(lookback=3, horizon=2, penalties=(0.5,), fit_on="all")
    model = sequence.fit_sequence(series(spark, values).repartition(3), cfg=cfg)
    z = (values - values.min()) / (values.max() - values.min() + 1e-8)
    train = z[:48]
    x = np.array([[1, *train[i : i + 3]] for i in range(48 - 4)])
    y = np.array([train[i + 3 : i + 5] for i in range(48 - 4)])
    ridge = np.diag([1e-9, 0.5, 0.5, 0.5])
    assert model.beta == pytest.approx(np.linalg.solve(x.T @ x + ridge, x.T @ y), abs=1e-9)


def test_sequence_stops_early_and_saves(spark, tmp_path):
    values = np.random.default_rng(7).normal(size=80)
    cfg = sequence.SequenceConfig(lookback=10, horizon=2, patience=1)
    model = sequence.fit_sequence(series(spark, values), cfg=cfg)
    assert len(model.history) < len(cfg.penalties)
    model.save(spark, str(tmp_path / "s"))
    again = sequence.SequenceModel.load(spark, str(tmp_path / "s"), cfg)
    assert again.beta == pytest.approx(model.beta)


def test_sequence_of_the_total(spark):
    total = series(spark, trend_wave(100)).select("date", "sales")
    cfg = sequence.SequenceConfig(lookback=14, horizon=3)
    model = sequence.fit_sequence(total, keys=(), cfg=cfg)
    assert column(model.predict(total), "date") == [day(100), day(101), day(102)]


def test_sequence_without_windows(spark):
    assert sequence.fit_sequence(series(spark, range(10))) is None
