import datetime as dt
import math
import sys
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from helpers import column, day, series
from retailcast.config import BacktestConfig
from retailcast.functions import metrics
from retailcast.operators import backtest, ensemble
from retailcast.plans import reports

# the models below are not on the path of the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("store_nbr", "family")
START = dt.date(2020, 1, 1)


def scores(spark, y, yhat):
    rows = [(float(a) if a is not None else None, float(b)) for a, b in zip(y, yhat, strict=True)]
    return spark.createDataFrame(rows, "y double, yhat double").agg(*metrics.all_metrics()).first()


@pytest.mark.parametrize(
    ("y", "yhat", "name", "value"),
    [
        ((100, 200), (110, 180), "mape", 10.0),
        ((0, 100), (5, 110), "mape", 10.0),
        ((0, 0), (1, 2), "mape", 0.0),
        ((1, 2, 3), (2, 2, 5), "mae", 1.0),
        ((10,), (13,), "rmse", 3.0),
        ((0, 0), (0, 0), "smape", 0.0),
        ((100,), (-100,), "smape", 200.0),
        ((1, None), (2, 2), "n_null", 1),
    ],
)
def test_metrics(spark, y, yhat, name, value):
    assert scores(spark, y, yhat)[name] == pytest.approx(value)


def stepped_windows(lo, hi, cfg):
    out, end, k = [], (pd.Timestamp(lo) + pd.DateOffset(months=cfg.train_window_months)).date(), 0
    while end + dt.timedelta(cfg.test_window_days) <= hi:
        out.append((k, lo, end, end + dt.timedelta(1), end + dt.timedelta(cfg.test_window_days)))
        end, k = end + dt.timedelta(cfg.step_days), k + 1
    return out


@pytest.mark.parametrize("days", [390, 394, 395, 401, 402, 500])
def test_windows_follow_the_dates(spark, days):
    cfg = BacktestConfig()
    got = backtest.backtest_windows(series(spark, [1] * days, start=START), cfg=cfg).orderBy("window_id").collect()
    assert [tuple(r) for r in got] == stepped_windows(START, day(days - 1, START), cfg)


def test_rolling_windows_move_their_start(spark):
    got = backtest.backtest_windows(series(spark, [1] * 500, start=START), rolling=True).orderBy("window_id").collect()
    assert got[3]["train_start"] == day(21, START)


def test_month_ends_are_clipped(spark):
    cfg = BacktestConfig(train_window_months=1, test_window_days=2)
    got = backtest.backtest_windows(series(spark, [1] * 60, start=dt.date(2023, 1, 31)), cfg=cfg).orderBy("window_id").first()
    assert got["train_end"] == dt.date(2023, 2, 28)


CFG = BacktestConfig(train_window_months=2, test_window_days=5, step_days=3, min_train_samples=20)


def by_window(values, skip, cfg, model):
    """Brute force: every window with its own masks."""
    frame = pd.DataFrame(
        [(pd.Timestamp(day(i, START)), float(v)) for i, v in enumerate(values) if i not in skip], columns=["date", "sales"]
    )
    out = {}
    for k, lo, end, first, last in stepped_windows(frame["date"].min().date(), frame["date"].max().date(), cfg):
        train = frame[(frame["date"] >= pd.Timestamp(lo)) & (frame["date"] <= pd.Timestamp(end))]
        test = frame[(frame["date"] >= pd.Timestamp(first)) & (frame["date"] <= pd.Timestamp(last))]
        if len(train) < cfg.min_train_samples or test.empty:
            continue
        for d, y, p in zip(test["date"], test["sales"], model(train, test), strict=True):
            out[k, d.date()] = (y, p)
    return out


def naive(train, test):
    return np.full(len(test), train["sales"].iloc[-1])


def mean_28(train, test):
    return np.full(len(test), train["sales"].iloc[-28:].mean())


VALUES = list(np.random.default_rng(3).integers(1, 50, 120))
SKIP = (5, 61, 62, 63, 64, 70, 90, 91, 92, 93, 94, 95, 96)


@pytest.mark.parametrize("skip", [(), SKIP])
def test_baselines_equal_brute_force(spark, skip):
    got = backtest.baseline_predictions(series(spark, VALUES, start=START, skip=skip), cfg=CFG).collect()
    for name, model in (("naive", naive), ("mean_28d", mean_28)):
        own = {(r["window_id"], r["date"]): (r["y"], r["yhat"]) for r in got if r["model"] == name}
        want = by_window(VALUES, skip, CFG, model)
        assert own.keys() == want.keys()
        assert all(own[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("per_task", [1, 4, 100])
def test_user_models_equal_brute_force(spark, per_task):
    df = series(spark, VALUES, start=START, skip=SKIP)
    got = backtest.model_predictions(df, {"m": mean_28}, cfg=CFG, windows_per_task=per_task).collect()
    want = by_window(VALUES, SKIP, CFG, mean_28)
    own = {(r["window_id"], r["date"]): (r["y"], r["yhat"]) for r in got}
    assert own.keys() == want.keys()
    assert all(own[k] == pytest.approx(want[k]) for k in want)


def test_baselines_need_enough_rows(spark):
    cfg = BacktestConfig(train_window_months=2, test_window_days=5, step_days=3, min_train_samples=1000)
    assert backtest.baseline_predictions(series(spark, VALUES, start=START), cfg=cfg).count() == 0


def test_a_failing_model_leaves_the_others(spark):
    def fails(train, test):
        raise RuntimeError("no fit")

    def short(train, test):
        return np.zeros(1)

    df = series(spark, VALUES, start=START)
    got = backtest.model_predictions(df, {"naive": naive, "fails": fails, "short": short}, cfg=CFG).cache()
    errors = {r["model"]: r["error"] for r in got.select("model", "error").distinct().collect()}
    assert errors["naive"] is None and "no fit" in errors["fails"] and "expected 5" in errors["short"]
    assert {r["model"] for r in backtest.window_metrics(got).collect()} == {"naive"}


def test_tested_rows_overlap_by_step(spark):
    rows = backtest.tested_rows(series(spark, [1] * 120, start=START), cfg=CFG).collect()
    assert all(r["test_start"] <= r["date"] <= r["test_end"] for r in rows)
    n_windows = len(stepped_windows(START, day(119, START), CFG))
    assert len(rows) == 5 * n_windows


def predictions(spark, errors, y=100.0):
    """Long predictions from a mapping of model to its errors."""
    rows = []
    for model, es in errors.items():
        rows += [(1, "A", 0, day(i), model, y, y - float(e)) for i, e in enumerate(es)]
    return spark.createDataFrame(
        rows, "store_nbr int, family string, window_id int, date date, model string, y double, yhat double"
    )


def test_diebold_mariano_of_equal_errors(spark):
    row = backtest.diebold_mariano(predictions(spark, {"a": [1, 2, 3], "b": [1, 2, 3]})).first()
    assert (row["statistic"], row["p_value"]) == (0.0, 1.0)


def test_diebold_mariano_by_hand(spark):
    rng = np.random.default_rng(1)
    e1, e2 = rng.normal(0, 1, 500), rng.normal(0, 10, 500)
    row = backtest.diebold_mariano(predictions(spark, {"good": e1, "bad": e2})).first()
    d = e2**2 - e1**2
    stat = d.mean() / math.sqrt(d.var(ddof=1) / 500)
    assert (row["model_a"], row["model_b"], row["n"]) == ("bad", "good", 500)
    assert row["statistic"] == pytest.approx(stat, rel=1e-6)
    assert row["p_value"] == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), abs=1e-12)


def test_diebold_mariano_needs_two_rows_and_two_models(spark):
    assert backtest.diebold_mariano(predictions(spark, {"a": [1], "b": [2]})).count() == 0
    assert backtest.diebold_mariano(predictions(spark, {"a": [1, 2]})).count() == 0


def test_aggregates_use_the_population_deviation(spark):
    rows = [(0, "a", 1.0), (1, "a", 3.0)]
    df = spark.createDataFrame([(w, m, v, v, v, v) for w, m, v in rows], "window_id int, model string, mape double, rmse double, mae double, smape double")
    assert backtest.aggregate_metrics(df).first()["mape_std"] == 1.0
    assert reports.metric_summary(df).first()["mape_std"] == pytest.approx(math.sqrt(2))


REPORT = "window_id int, model string, test_start date, mape double, rmse double"


def report(spark):
    rows = [(0, "b", day(0), 5.0, 1.0), (0, "a", day(0), 5.0, 2.0), (1, "b", day(7), 1.0, 3.0), (1, "a", day(7), 2.0, 10.0)]
    return spark.createDataFrame(rows, REPORT)


def test_windows_won_breaks_ties_by_name(spark):
    assert {r["model"]: r["windows_won"] for r in reports.windows_won(report(spark)).collect()} == {"a": 1, "b": 1}


def test_comparison_flags_the_best(spark):
    rows = {r["model"]: r for r in reports.model_comparison(report(spark)).collect()}
    assert rows["b"]["best_mape"] and rows["b"]["best_rmse"] and not rows["a"]["best_rmse"]


def test_histogram_and_box(spark):
    counts = reports.error_histogram(report(spark), bins=3).collect()
    assert {(r["model"], r["bucket"]): r["n"] for r in counts} == {("b", 0): 2, ("a", 0): 1, ("a", 2): 1}
    box = {r["model"]: r for r in reports.error_box(report(spark)).collect()}
    assert box["b"]["median"] == 2.0 and box["a"]["whisker_high"] == 10.0


def test_naive_band(spark):
    out = reports.naive_band(series(spark, [1, 2, 3]), horizon=2)
    assert column(out, "prediction") == [3, 3]
    assert column(out, "upper")[0] == pytest.approx(3 + 1.96)
    single = reports.naive_band(series(spark, [4]), horizon=1).first()
    assert (single["lower"], single["upper"]) == (4, 4)


def three_models(spark):
    rng = np.random.default_rng(42)
    y = rng.normal(100, 10, 50)
    return y, {"additive": rng.normal(100, 10, 50), "sequence": y + rng.normal(0, 3, 50), "boosted": rng.normal(100, 8, 50)}


def long_rows(spark, y, models):
    rows = [(1, "A", day(i), m, float(y[i]), float(p[i])) for m, p in models.items() for i in range(len(y))]
    return spark.createDataFrame(rows, "store_nbr int, family string, date date, model string, y double, yhat double")


def every_support(gram, cross):
    """The best weights over all sets of models, by trying each."""
    m, best, best_loss = len(cross), None, np.inf
    for size in range(1, m + 1):
        for support in combinations(range(m), size):
            s = list(support)
            system = np.ones((size + 1, size + 1))
            system[:size, :size], system[size, size] = gram[np.ix_(s, s)], 0.0
            found = np.linalg.lstsq(system, np.append(cross[s], 1.0), rcond=None)[0][:size]
            if (found < -1e-12).any() or abs(found.sum() - 1) > 1e-9:
                continue
            w = np.zeros(m)
            w[s] = np.maximum(found, 0)
            loss = w @ gram @ w - 2 * w @ cross
            if loss < best_loss - 1e-12:
                best, best_loss = w, loss
    return best


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8])
def test_active_set_equals_all_supports(m):
    rng = np.random.default_rng(m)
    for _ in range(25):
        y = rng.normal(10, 3, 60)
        p = y[:, None] * rng.uniform(0, 1.2, m) + rng.normal(0, 2, (60, m)) + rng.normal(0, 3, m)
        gram, cross = p.T @ p / 60, p.T @ y / 60
        found = ensemble.simplex_weights(gram, cross)
        assert found == pytest.approx(every_support(gram, cross), abs=1e-7) and found.sum() == pytest.approx(1)


def test_weights_of_many_and_of_equal_models():
    rng = np.random.default_rng(3)
    y = rng.normal(10, 3, 500)
    p = y[:, None] + rng.normal(0, 1, (500, 30)) + rng.normal(0, 1, 30)
    gram, cross = p.T @ p, p.T @ y
    began = time.perf_counter()
    w = ensemble.simplex_weights(gram, cross)
    assert time.perf_counter() - began < 1 and w.min() >= 0 and w.sum() == pytest.approx(1)
    slope = gram @ w - cross
    assert (slope - slope @ w >= -1e-6 * np.abs(gram).max()).all()  # no model outside lowers the error
    twins = np.column_stack([y + 1, y + 1, y - 3])
    found = ensemble.simplex_weights(twins.T @ twins, twins.T @ y)
    assert found == pytest.approx([0.75, 0, 0.25])
    assert ensemble.simplex_weights(np.zeros((2, 2)), np.zeros(2)) == pytest.approx([1, 0])


def test_weights_are_the_best_on_the_simplex(spark):
    y, models = three_models(spark)
    row = ensemble.optimize_weights(long_rows(spark, y, models)).first()
    w = row["weights"]
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
    stacked = np.column_stack([models[m] for m in ensemble.MODELS])
    found = np.sqrt(np.mean((y - stacked @ [w[m] for m in ensemble.MODELS]) ** 2))
    assert row["rmse"] == pytest.approx(found)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)]
    assert found <= min(np.sqrt(np.mean((y - stacked @ g) ** 2)) for g in grid) + 1e-9


def test_identical_models_and_no_rows_keep_valid_weights(spark):
    y = np.arange(5.0)
    same = {m: y + 1 for m in ensemble.MODELS}
    assert sum(ensemble.optimize_weights(long_rows(spark, y, same)).first()["weights"].values()) == pytest.approx(1)
    empty = ensemble.optimize_weights(long_rows(spark, y, same).limit(0)).first()
    assert empty["weights"] == pytest.approx(ensemble.equal_weights())


def test_ensemble_ignores_models_without_weight(spark):
    y = np.zeros(1)
    rows = long_rows(spark, y, {"additive": [10.0], "sequence": [20.0], "other": [90.0]})
    row = ensemble.ensemble_predict(rows, {"additive": 0.5, "sequence": 0.25, "boosted": 0.25}).first()
    assert row["yhat"] == pytest.approx(10 / 0.75 * 0.5 + 20 / 0.75 * 0.25)
    spread = np.std([10, 20, 90])
    assert row["upper"] - row["yhat"] == pytest.approx(1.96 * spread)


def test_ensemble_without_any_weight_is_zero(spark):
    rows = long_rows(spark, np.zeros(1), {"other": [5.0]})
    assert ensemble.ensemble_predict(rows, {"additive": 1.0}).first()["yhat"] == 0.0
    assert ensemble.ensemble_predict(rows, {}).first()["yhat"] == 0.0


def test_ensemble_weights_given_bounds(spark):
    from pyspark.sql import functions as F

    rows = long_rows(spark, np.zeros(1), {"additive": [10.0], "sequence": [20.0]})
    bounded = rows.withColumns({"lower": F.col("yhat") - 1, "upper": F.col("yhat") + 3})
    row = ensemble.ensemble_predict(bounded, {"additive": 0.5, "sequence": 0.5}).first()
    assert (row["lower"], row["yhat"], row["upper"]) == (14, 15, 18)
