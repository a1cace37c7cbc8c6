"""Forecasts that are null, and reports over many series."""

from pyspark.sql import functions as F

from retailcast.functions.metrics import all_metrics
from retailcast.operators import backtest, ensemble
from retailcast.operators.forest import IsolationForest
from retailcast.operators.panel import require_daily_grain
from retailcast.plans import reports


def test_a_model_without_forecasts_has_no_score(spark):
    rows = spark.createDataFrame([(1, "none", 5.0, None), (1, "some", 5.0, None), (1, "some", 4.0, 5.0)], "window_id int, model string, y double, yhat double")
    got = {r["model"]: r for r in rows.groupBy("window_id", "model").agg(*all_metrics()).collect()}
    assert got["none"]["mape"] is got["none"]["smape"] is got["none"]["rmse"] is None and got["none"]["n_null"] == 1
    assert got["some"]["mape"] == 25.0 and got["some"]["n_scored"] == 1
    won = reports.windows_won(rows.groupBy("window_id", "model").agg(*all_metrics())).collect()
    assert [(r["model"], r["windows_won"]) for r in won] == [("some", 1)]


def test_zero_denominators_still_score_zero(spark):
    rows = spark.createDataFrame([(0.0, 3.0)], "y double, yhat double")
    assert rows.agg(*all_metrics()).first()["mape"] == 0.0


def test_null_forecasts_carry_no_weight(spark):
    rows = [("2024-01-01", "a", 10.0), ("2024-01-01", "b", None), ("2024-01-02", "a", None), ("2024-01-02", "b", None)]
    long = spark.createDataFrame(rows, "date string, model string, yhat double")
    got = ensemble.ensemble_predict(long, {"a": 0.5, "b": 0.5}, keys=()).orderBy("date").collect()
    assert [r["yhat"] for r in got] == [10.0, None]


def by_series(spark):
    rows = [(s, "F", 0, m, float(e)) for s, m, e in ((1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 1), (3, "a", 3), (3, "b", 1))]
    df = spark.createDataFrame(rows, "store_nbr int, family string, window_id int, model string, mape double")
    return df.withColumns({"test_start": F.lit("2024-01-01").cast("date"), **{m: F.col("mape") for m in ("rmse", "mae", "smape")}})


def test_reports_keep_the_series(spark):
    report = by_series(spark)
    flat = backtest.flat_report(report)
    assert flat.columns[:2] == ["store_nbr", "family"] and flat.distinct().count() == 6
    assert {r["model"]: r["windows_won"] for r in reports.windows_won(report).collect()} == {"a": 1, "b": 2}
    assert "store_nbr" in reports.metric_over_windows(report).columns
    assert reports.metric_summary(report, keys=("store_nbr",)).count() == 6
    best = reports.model_comparison(report, keys=("store_nbr",)).where("best_mape")
    assert {(r["store_nbr"], r["model"]) for r in best.collect()} == {(1, "a"), (2, "b"), (3, "b")}


def test_rows_without_a_series_pass_the_grain_check(spark):
    rows = spark.createDataFrame([(None, "A", 1), (None, "A", 1), (1, "A", 1)], "store_nbr int, family string, sales int")
    dated = rows.withColumn("date", F.lit("2024-01-01").cast("date"))
    assert require_daily_grain(dated).count() == 3


def test_every_row_can_be_drawn(spark):
    """With all rows alike but the last ones of the hash order, trees still see those."""
    df = spark.range(12_000).select("id", F.rand(1).alias("x"))
    forest = IsolationForest(n_trees=20).fit(df, ["x"], ["id"])
    assert forest.drawn == 256 and len(forest.trees) == 20
