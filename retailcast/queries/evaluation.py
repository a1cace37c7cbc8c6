"""Backtests, reports, forecasters and the ensemble."""

from pyspark.sql import functions as F

from retailcast.models import additive, reservoir, sequence, series_boosted
from retailcast.operators import backtest, ensemble, features, panel
from retailcast.operators.registry import ModelRegistry
from retailcast.plans import bindings as b
from retailcast.plans import reports
from retailcast.queries.registry import register
from retailcast.queries.shaping import P
from retailcast.queries.tables import DENSE, HOLIDAY_ROWS, SALES
from retailcast.session import scratch_path

_KEY = "PARTITION BY store_nbr, family"

# ---- windows and baselines

_WINDOWS = f"""{DENSE}, w0 AS (SELECT MIN(date) AS lo, MAX(date) AS hi,
    CAST(MIN(date) + INTERVAL 12 MONTH AS DATE) AS first FROM dense),
  windows AS (SELECT i AS window_id, lo AS train_start, CAST(first + CAST(7 * i AS INT) AS DATE) AS train_end,
    CAST(first + CAST(7 * i + 1 AS INT) AS DATE) AS test_start, CAST(first + CAST(7 * i + 28 AS INT) AS DATE) AS test_end
    FROM w0, generate_series(0, 10000) AS g(i) WHERE first + CAST(7 * i + 28 AS INT) <= hi)"""

_WINDOW_SPEC = "window_id i, train_start d, train_end d, test_start d, test_end d"


@register("b1_windows", _WINDOW_SPEC, f"WITH {_WINDOWS} SELECT * FROM windows")
def windows(spark, sf):
    return backtest.backtest_windows(b.dense_sales(spark, sf))


@register(
    "b1_windows_by_series",
    f"store_nbr i, family s, {_WINDOW_SPEC}",
    f"""WITH {SALES}, r AS (SELECT store_nbr, family, MIN(date) AS lo, MAX(date) AS hi,
      CAST(MIN(date) + INTERVAL 12 MONTH AS DATE) AS first FROM sales GROUP BY 1, 2)
    SELECT store_nbr, family, i AS window_id, lo AS train_start, CAST(first + CAST(7 * i AS INT) AS DATE) AS train_end,
      CAST(first + CAST(7 * i + 1 AS INT) AS DATE) AS test_start, CAST(first + CAST(7 * i + 28 AS INT) AS DATE) AS test_end
    FROM r, generate_series(0, 10000) AS g(i) WHERE first + CAST(7 * i + 28 AS INT) <= hi""",
)
def windows_by_series(spark, sf):
    return backtest.backtest_windows(b.sales(spark, sf), keys=("store_nbr", "family"))


@register(
    "j7_test_rows",
    f"date d, store_nbr i, family s, sales f, {_WINDOW_SPEC}",
    f"WITH {_WINDOWS} SELECT d.*, w.* FROM dense d JOIN windows w ON d.date BETWEEN test_start AND test_end",
)
def test_period_rows(spark, sf):
    return backtest.tested_rows(b.dense_sales(spark, sf), span="global")


_PREDICTED = f"""{_WINDOWS}, st AS (SELECT *, ROW_NUMBER() OVER {P} AS n,
    AVG(sales) OVER ({_KEY} ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS mean FROM dense),
  train AS (SELECT store_nbr, family, window_id, n, sales AS naive, mean FROM st JOIN windows ON date = train_end),
  paired AS (SELECT d.store_nbr, d.family, w.window_id, d.date, d.sales AS y, naive, mean
    FROM dense d JOIN windows w ON d.date BETWEEN test_start AND test_end
    JOIN train t ON t.store_nbr = d.store_nbr AND t.family = d.family AND t.window_id = w.window_id WHERE n >= 365),
  predicted AS (SELECT store_nbr, family, window_id, date, 'naive' AS model, y, naive AS yhat FROM paired
    UNION ALL SELECT store_nbr, family, window_id, date, 'mean_28d', y, mean FROM paired)"""

_METRICS = f"""{_PREDICTED}, metrics AS (SELECT window_id, model,
    COALESCE(AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100, 0) AS mape,
    SQRT(AVG((y - yhat) * (y - yhat))) AS rmse, AVG(ABS(y - yhat)) AS mae,
    COALESCE(AVG(CASE WHEN ABS(y) + ABS(yhat) <> 0 THEN ABS(y - yhat) / ((ABS(y) + ABS(yhat)) / 2) END) * 100, 0) AS smape,
    COUNT(*) AS n_scored FROM predicted GROUP BY 1, 2)"""

_METRIC_SPEC = "mape f, rmse f, mae f, smape f"


def baselines(spark, sf):
    return backtest.baseline_predictions(b.dense_sales(spark, sf))


def baseline_metrics(spark, sf):
    return backtest.window_metrics(baselines(spark, sf))


def baseline_report(spark, sf):
    dense = b.dense_sales(spark, sf)
    metrics = backtest.window_metrics(backtest.baseline_predictions(dense))
    return backtest.backtest_report(metrics, backtest.backtest_windows(dense))


@register(
    "b3_baselines",
    "store_nbr i, family s, window_id i, date d, model s, y f, yhat f",
    f"WITH {_PREDICTED} SELECT * FROM predicted",
)
def baseline_rows(spark, sf):
    return baselines(spark, sf)


@register("b5_metrics", f"window_id i, model s, {_METRIC_SPEC}, n_scored i", f"WITH {_METRICS} SELECT * FROM metrics")
def metrics(spark, sf):
    return baseline_metrics(spark, sf)


@register(
    "a17_metrics_by_series",
    f"store_nbr i, family s, window_id i, model s, {_METRIC_SPEC}",
    f"""WITH {_PREDICTED} SELECT store_nbr, family, window_id, model,
    COALESCE(AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100, 0) AS mape,
    SQRT(AVG((y - yhat) * (y - yhat))) AS rmse, AVG(ABS(y - yhat)) AS mae,
    COALESCE(AVG(CASE WHEN ABS(y) + ABS(yhat) <> 0 THEN ABS(y - yhat) / ((ABS(y) + ABS(yhat)) / 2) END) * 100, 0) AS smape
    FROM predicted GROUP BY 1, 2, 3, 4""",
)
def metrics_by_series(spark, sf):
    return backtest.window_metrics(baselines(spark, sf), keys=("store_nbr", "family"))


def _means_sql(deviation):
    return ", ".join(f"AVG({m}) AS {m}_mean, {deviation}({m}) AS {m}_std" for m in ("mape", "rmse", "mae", "smape"))


_MEANS_SPEC = "model s, " + ", ".join(f"{m}_mean f, {m}_std f" for m in ("mape", "rmse", "mae", "smape"))


@register("b6_aggregate_metrics", _MEANS_SPEC, f"WITH {_METRICS} SELECT model, {_means_sql('STDDEV_POP')} FROM metrics GROUP BY 1")
def aggregate_metrics(spark, sf):
    return backtest.aggregate_metrics(baseline_metrics(spark, sf))


_DM = f"""{_PREDICTED}, e AS (SELECT a.store_nbr, a.family, a.window_id, a.date, a.model AS model_a, z.model AS model_b,
    (a.y - a.yhat) * (a.y - a.yhat) - (z.y - z.yhat) * (z.y - z.yhat) AS d
    FROM predicted a JOIN predicted z ON a.store_nbr = z.store_nbr AND a.family = z.family
      AND a.window_id = z.window_id AND a.date = z.date AND a.model < z.model)"""


@register(
    "b7_diebold_mariano",
    "model_a s, model_b s, n i, statistic f",
    f"""WITH {_DM} SELECT model_a, model_b, COUNT(*) AS n,
      CASE WHEN VAR_SAMP(d) = 0 THEN 0 ELSE AVG(d) / SQRT(VAR_SAMP(d) / COUNT(*)) END AS statistic FROM e GROUP BY 1, 2""",
)
def diebold_mariano(spark, sf):
    return backtest.diebold_mariano(baselines(spark, sf), models=("naive", "mean_28d"))


@register(
    "j10_model_pairs_by_series",
    "store_nbr i, family s, model_a s, model_b s, n i, statistic f",
    f"""WITH {_DM} SELECT store_nbr, family, model_a, model_b, COUNT(*) AS n,
      CASE WHEN VAR_SAMP(d) = 0 THEN 0 ELSE AVG(d) / SQRT(VAR_SAMP(d) / COUNT(*)) END AS statistic
    FROM e GROUP BY 1, 2, 3, 4""",
)
def model_pairs_by_series(spark, sf):
    return backtest.diebold_mariano(
        baselines(spark, sf), models=("naive", "mean_28d"), by=("store_nbr", "family")
    )


# fixed values: complementary error function by Abramowitz and Stegun 7.1.26, error below 2e-7
_ERFC = """t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * EXP(-x * x)"""


@register(
    "b7_p_values",
    "model_a s, model_b s, n i, statistic f, p_value f4",
    f"""WITH {_DM}, s AS (SELECT model_a, model_b, COUNT(*) AS n, AVG(d) / SQRT(VAR_SAMP(d) / COUNT(*)) AS statistic
      FROM e GROUP BY 1, 2),
    x AS (SELECT *, ABS(statistic) / SQRT(2) AS x, 1 / (1 + 0.3275911 * ABS(statistic) / SQRT(2)) AS t FROM s)
    SELECT *, {_ERFC} AS p_value FROM x""",
)
def p_values(spark, sf):
    return backtest.diebold_mariano(baselines(spark, sf))


@register(
    "b7_p_values_by_series",
    "store_nbr i, family s, statistic f, p_value f4",
    f"""WITH {_DM}, s AS (SELECT store_nbr, family, AVG(d) / SQRT(VAR_SAMP(d) / COUNT(*)) AS statistic FROM e GROUP BY 1, 2),
    x AS (SELECT *, ABS(statistic) / SQRT(2) AS x, 1 / (1 + 0.3275911 * ABS(statistic) / SQRT(2)) AS t FROM s)
    SELECT *, {_ERFC} AS p_value FROM x""",
)
def p_values_by_series(spark, sf):
    return backtest.diebold_mariano(baselines(spark, sf), models=("naive", "mean_28d"), by=("store_nbr", "family"))


@register(
    "a18_loss_differences",
    "store_nbr i, family s, n i, mean f4, variance f2",
    f"""WITH {_DM} SELECT store_nbr, family, COUNT(*) AS n, AVG(d) AS mean, VAR_SAMP(d) AS variance FROM e GROUP BY 1, 2""",
)
def loss_differences(spark, sf):
    by = ("store_nbr", "family")
    return backtest.loss_differences(baselines(spark, sf), models=("mean_28d", "naive"), by=by).drop("model_a", "model_b")


_REPORT = f"""{_METRICS}, report AS (SELECT m.window_id, train_start, train_end, test_start, test_end, model,
    mape, rmse, mae, smape FROM metrics m JOIN windows w ON m.window_id = w.window_id)"""


@register("b8_report", f"{_WINDOW_SPEC}, model s, {_METRIC_SPEC}", f"WITH {_REPORT} SELECT * FROM report")
def report(spark, sf):
    return baseline_report(spark, sf)


@register(
    "b9_flat_report",
    f"window_id i, test_start s, model s, {_METRIC_SPEC}",
    f"WITH {_REPORT} SELECT * REPLACE (STRFTIME(test_start, '%Y-%m-%d') AS test_start) FROM report",
)
def flat_report(spark, sf):
    return backtest.flat_report(baseline_report(spark, sf))


@register(
    "u3_model_names",
    "model s, n_windows i",
    f"WITH {_METRICS} SELECT model, COUNT(DISTINCT window_id) AS n_windows FROM metrics GROUP BY 1",
)
def model_names(spark, sf):
    predictions = baselines(spark, sf)
    return predictions.select("model", "window_id").distinct().groupBy("model").agg(F.count(F.lit(1)).alias("n_windows")).orderBy("model")


# ---- report queries


@register(
    "t1_naive_band",
    "store_nbr i, family s, date d, prediction f, lower f, upper f",
    f"""WITH {SALES}, e AS (SELECT store_nbr, family, MAX(date) AS last, ARG_MAX(sales, date) AS v,
      COALESCE(STDDEV_SAMP(sales), 0) AS sd FROM sales GROUP BY 1, 2)
    SELECT store_nbr, family, CAST(last + CAST(i AS INT) AS DATE) AS date, v AS prediction,
      v - 1.96 * sd AS lower, v + 1.96 * sd AS upper FROM e, generate_series(1, 28) AS g(i)""",
)
def naive_band(spark, sf):
    return reports.naive_band(b.sales(spark, sf))


@register(
    "t2_model_comparison",
    f"model s, {_METRIC_SPEC}, best_mape b, best_rmse b, best_mae b, best_smape b",
    f"""WITH {_METRICS}, a AS (SELECT model, AVG(mape) AS mape, AVG(rmse) AS rmse, AVG(mae) AS mae, AVG(smape) AS smape
      FROM metrics GROUP BY 1)
    SELECT *, mape = MIN(mape) OVER () AS best_mape, rmse = MIN(rmse) OVER () AS best_rmse,
      mae = MIN(mae) OVER () AS best_mae, smape = MIN(smape) OVER () AS best_smape FROM a""",
)
def model_comparison(spark, sf):
    return reports.model_comparison(baseline_metrics(spark, sf))


@register("a9_mean_metrics", f"model s, {_METRIC_SPEC}", f"""WITH {_METRICS} SELECT model, AVG(mape) AS mape,
    AVG(rmse) AS rmse, AVG(mae) AS mae, AVG(smape) AS smape FROM metrics GROUP BY 1""")
def mean_metrics(spark, sf):
    return reports.model_comparison(baseline_metrics(spark, sf))


@register(
    "t3_error_histogram",
    "model s, bucket i, n i",
    f"""WITH {_METRICS}, s AS (SELECT MIN(rmse) AS lo, MAX(rmse) AS hi FROM metrics)
    SELECT model, LEAST(FLOOR((rmse - lo) * 30 / (hi - lo)), 29) AS bucket, COUNT(*) AS n FROM metrics, s GROUP BY 1, 2""",
)
def error_histogram(spark, sf):
    return reports.error_histogram(baseline_metrics(spark, sf))


@register(
    "t3_error_box",
    "model s, whisker_low f, q1 f, median f, q3 f, whisker_high f",
    f"""WITH {_METRICS}, q AS (SELECT model, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS median,
      quantile_cont(rmse, 0.75) AS q3 FROM metrics GROUP BY 1)
    SELECT q.model, MIN(CASE WHEN rmse >= q1 - 1.5 * (q3 - q1) THEN rmse END) AS whisker_low, ANY_VALUE(q1) AS q1,
      ANY_VALUE(median) AS median, ANY_VALUE(q3) AS q3,
      MAX(CASE WHEN rmse <= q3 + 1.5 * (q3 - q1) THEN rmse END) AS whisker_high
    FROM metrics m JOIN q ON m.model = q.model GROUP BY 1""",
)
def error_box(spark, sf):
    return reports.error_box(baseline_metrics(spark, sf), models=("naive", "mean_28d"))


@register(
    "t4_mape_over_windows",
    "model s, test_start d, mape f",
    f"WITH {_REPORT} SELECT model, test_start, mape FROM report",
)
def mape_over_windows(spark, sf):
    return reports.metric_over_windows(baseline_report(spark, sf))


@register(
    "t5_windows_won",
    "model s, windows_won i",
    f"""WITH {_METRICS}, best AS (SELECT window_id, model FROM metrics
      QUALIFY ROW_NUMBER() OVER (PARTITION BY window_id ORDER BY mape, model) = 1)
    SELECT model, COUNT(*) AS windows_won FROM best GROUP BY 1""",
)
def windows_won(spark, sf):
    return reports.windows_won(baseline_metrics(spark, sf))


@register("t6_metric_summary", _MEANS_SPEC, f"WITH {_METRICS} SELECT model, {_means_sql('STDDEV_SAMP')} FROM metrics GROUP BY 1")
def metric_summary(spark, sf):
    return reports.metric_summary(baseline_metrics(spark, sf))


# ---- user models in the backtest


def last_week(train, test):
    """A user model: the value of the same weekday in the last seven training rows."""
    by_day = train.tail(7).groupby(train["date"].dt.dayofweek)["sales"].last()
    return test["date"].dt.dayofweek.map(by_day).to_numpy()


def broken(train, test):
    raise ValueError("cannot fit")


_LAST_WEEK = f"""{_WINDOWS}, predicted AS (SELECT d.store_nbr, d.family, w.window_id, d.date, d.sales AS y, t.sales AS yhat
    FROM dense d JOIN windows w ON d.date BETWEEN test_start AND test_end
    JOIN dense t ON t.store_nbr = d.store_nbr AND t.family = d.family AND t.date BETWEEN train_end - 6 AND train_end
      AND isodow(t.date) = isodow(d.date))"""


@register(
    "x1_user_models",
    "store_nbr i, family s, window_id i, date d, model s, y f, yhat f, error s",
    f"""WITH {_LAST_WEEK} SELECT *, 'last_week' AS model, NULL AS error FROM predicted
    UNION ALL SELECT store_nbr, family, window_id, date, y, NULL, 'broken', 'ValueError: cannot fit' FROM predicted""",
)
def user_models(spark, sf):
    return backtest.model_predictions(b.dense_sales(spark, sf), {"last_week": last_week, "broken": broken})


@register(
    "b2_run_backtest",
    f"window_id i, model s, {_METRIC_SPEC}",
    f"""WITH {_LAST_WEEK} SELECT window_id, 'last_week' AS model,
    COALESCE(AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100, 0) AS mape,
    SQRT(AVG((y - yhat) * (y - yhat))) AS rmse, AVG(ABS(y - yhat)) AS mae,
    COALESCE(AVG(CASE WHEN ABS(y) + ABS(yhat) <> 0 THEN ABS(y - yhat) / ((ABS(y) + ABS(yhat)) / 2) END) * 100, 0) AS smape
    FROM predicted GROUP BY 1""",
)
def run_backtest(spark, sf):
    predictions = backtest.model_predictions(b.dense_sales(spark, sf), {"last_week": last_week, "broken": broken})
    return backtest.window_metrics(predictions)


@register("b4_additive_backtest", f"window_id i, model s, {_METRIC_SPEC}, n_scored i")
def additive_backtest(spark, sf):
    return backtest.window_metrics(additive.window_predictions(b.dense_sales(spark, sf)))


# ---- additive forecaster


@register(
    "f5_holiday_windows",
    "date d, holiday s, shift i",
    f"""WITH {HOLIDAY_ROWS} SELECT CAST(date + CAST(i AS INT) AS DATE) AS date, description AS holiday, i AS shift
    FROM holidays, generate_series(-1, 1) AS g(i)""",
)
def holiday_windows(spark, sf):
    return additive.holiday_windows(b.holidays(spark, sf)).withColumnRenamed("offset", "shift")


@register(
    "m2_prepare",
    "store_nbr i, family s, ds d, y f",
    f"WITH {SALES} SELECT store_nbr, family, date AS ds, sales AS y FROM sales",
)
def prepare(spark, sf):
    gapped = panel.densify(b.sales(spark, sf), fill=None, span="global")
    return additive.prepare(gapped)


@register("m1_m3_fit_additive", "store_nbr i, family s, start d, last d, n i, n_beta i, sigma f4")
def fit_additive(spark, sf):
    fitted = additive.fit_additive(b.dense_sales(spark, sf), holidays=b.holidays(spark, sf))
    return fitted.withColumn("n_beta", F.size("beta"))


@register("m4_predict_additive", "store_nbr i, family s, ds d, yhat f4, lower f4, upper f4")
def predict_additive(spark, sf):
    holidays, path = b.holidays(spark, sf), scratch_path(spark, "additive")
    additive.fit_additive(b.dense_sales(spark, sf), holidays=holidays).write.parquet(path)
    return additive.predict_additive(spark.read.parquet(path), 28, holidays=holidays)


@register("s12_stored_models", "store_nbr i, family s, ds d, yhat f4, lower f4, upper f4")
def stored_models(spark, sf):
    path = scratch_path(spark, "additive")
    additive.fit_additive(b.dense_sales(spark, sf)).write.parquet(path)
    return additive.predict_additive(spark.read.parquet(path), 28, history=b.dense_sales(spark, sf))


@register("m1_simulated_intervals", "store_nbr i, family s, ds d, sales f, yhat f4, lower f4, upper f4, inside b")
def simulated_intervals(spark, sf):
    """The last 28 days of every series against the bounds of 500 simulated futures of a fit that ends before them."""
    dense, path = b.dense_sales(spark, sf), scratch_path(spark, "additive")
    ends = dense.select(F.date_sub(F.max("date"), 28).alias("cut"))
    cfg = additive.AdditiveConfig(trend_paths=500)
    additive.fit_additive(dense.where(F.col("date") <= ends.scalar()), cfg=cfg).write.parquet(path)
    bands = additive.predict_additive(spark.read.parquet(path), 28, cfg=cfg).withColumnRenamed("ds", "date")
    known = bands.join(dense.select("store_nbr", "family", "date", "sales"), ["store_nbr", "family", "date"])
    return known.withColumn("inside", F.col("sales").between(F.col("lower"), F.col("upper"))).withColumnRenamed("date", "ds")


# ---- boosted trees


def boosted_frame(spark, sf):
    """All engineered features, written once: fitting and scoring both read them."""
    path = scratch_path(spark, "features")
    features.engineer_all_features(b.merged_sales(spark, sf), b.holidays(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@register("m7_m8_boosted_predictions", "date d, store_nbr i, family s, prediction f4")
def boosted_predictions(spark, sf):
    frame = boosted_frame(spark, sf)
    return series_boosted.fit_series_boosters(frame).predict(frame)


@register("m6_l2_top_features", "feature s, importance f4")
def top_features(spark, sf):
    return series_boosted.fit_series_boosters(boosted_frame(spark, sf)).top_features(10)


@register("m5_boosting_rounds", "store_nbr i, family s, round i, train_rmse f4, valid_rmse f4, best b")
def boosting_rounds(spark, sf):
    return series_boosted.fit_series_boosters(boosted_frame(spark, sf)).rounds()


@register("m8_future_days", "store_nbr i, family s, date d, yhat f4")
def future_days(spark, sf):
    panel = b.merged_sales(spark, sf)
    return series_boosted.fit_series_boosters(boosted_frame(spark, sf)).roll_forward(panel, 28, b.holidays(spark, sf))


# ---- sequence forecaster


@register(
    "m9_w11_supervised_windows",
    "store_nbr i, family s, date d, x_first f, x_last f, y_first f, y_last f, n_x i, n_y i",
    f"""WITH {DENSE}, t AS (SELECT store_nbr, family, date, LAG(sales, 27) OVER w AS x_first, sales AS x_last,
      LEAD(sales, 1) OVER w AS y_first, LEAD(sales, 7) OVER w AS y_last FROM dense
      WINDOW w AS ({_KEY} ORDER BY date))
    SELECT *, 28 AS n_x, 7 AS n_y FROM t WHERE x_first IS NOT NULL AND y_last IS NOT NULL""",
)
def supervised_windows(spark, sf):
    w = sequence.supervised_windows(b.dense_sales(spark, sf), 28, 7)
    return w.select(
        "store_nbr",
        "family",
        "date",
        F.get("x", F.lit(0)).alias("x_first"),
        F.get("x", F.lit(27)).alias("x_last"),
        F.get("y", F.lit(0)).alias("y_first"),
        F.get("y", F.lit(6)).alias("y_last"),
        F.size("x").alias("n_x"),
        F.size("y").alias("n_y"),
    )


@register("m10_m11_sequence_forecast", "store_nbr i, family s, date d, yhat f4")
def sequence_forecast(spark, sf):
    dense = b.dense_sales(spark, sf).persist()
    return sequence.fit_sequence(dense, cfg=sequence.SequenceConfig(horizon=7)).predict(dense)


@register("m12_loss_history", "step i, penalty f, train_loss f6, val_loss f6, best b")
def loss_history(spark, sf):
    return sequence.fit_sequence(b.dense_sales(spark, sf), cfg=sequence.SequenceConfig(horizon=7)).losses(spark)


@register("m13_total_forecast", "date d, yhat f4")
def total_forecast(spark, sf):
    total = panel.daily_total(b.dense_sales(spark, sf)).persist()
    return sequence.fit_sequence(total, keys=(), cfg=sequence.SequenceConfig(horizon=7)).predict(total)


RESERVOIR = reservoir.ReservoirConfig(horizon=7)


def _state_sql() -> str:
    """States of every day by a recursive query: the layer's weights as lists, a step a day."""
    into, weights = reservoir.layer(RESERVOIR, 1)
    numbers = lambda values: "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"
    matrix = "[" + ", ".join(numbers(row) for row in weights.tolist()) + "]"
    n, keep = RESERVOIR.units, 1.0 - RESERVOIR.leak
    return f"""WITH RECURSIVE {DENSE}, p AS (SELECT *, ROW_NUMBER() OVER w AS pos,
      FLOOR(COUNT(*) OVER ({_KEY}) * 0.8) AS cut FROM dense WINDOW w AS ({_KEY} ORDER BY date)),
    bounds AS (SELECT store_nbr, family, MIN(sales) FILTER (pos <= cut) AS lo, MAX(sales) FILTER (pos <= cut) AS hi
      FROM p GROUP BY 1, 2),
    u AS (SELECT store_nbr, family, date, pos, pos <= cut AS is_train, (sales - lo) / (hi - lo + 1e-8) AS u
      FROM p JOIN bounds USING (store_nbr, family)),
    s AS (SELECT store_nbr, family, 0::BIGINT AS pos, list_transform(range({n}), lambda i: 0.0::DOUBLE) AS x
      FROM bounds UNION ALL
      SELECT s.store_nbr, s.family, u.pos, list_transform(range(1, {n + 1}), lambda i: {keep!r}::DOUBLE * s.x[i]
        + {RESERVOIR.leak!r}::DOUBLE * tanh(l.bias[i] + l.into[i] * u.u + list_dot_product(l.weights[i], s.x)))
      FROM s JOIN u ON u.store_nbr = s.store_nbr AND u.family = s.family AND u.pos = s.pos + 1,
      (SELECT {numbers(into[:, 0].tolist())} AS bias, {numbers(into[:, 1].tolist())} AS into, {matrix} AS weights) AS l),
    y AS (SELECT *, LEAD(u, {RESERVOIR.horizon}) OVER w AS y_last, ROW_NUMBER() OVER w AS place
      FROM u WINDOW w AS ({_KEY}, is_train ORDER BY date))
    SELECT y.store_nbr, y.family, y.date, y.is_train, s.x[1] AS x_first, s.x[{n}] AS x_last, list_sum(s.x) AS x_sum, y.y_last
    FROM y JOIN s ON s.store_nbr = y.store_nbr AND s.family = y.family AND s.pos = y.pos
    WHERE y.y_last IS NOT NULL AND y.place >= {RESERVOIR.washout}"""


@register(
    "m10_reservoir_states",
    "store_nbr i, family s, date d, is_train b, x_first f, x_last f, x_sum f, y_last f",
    _state_sql(),
)
def reservoir_states(spark, sf):
    w = reservoir.reservoir_windows(b.dense_sales(spark, sf), cfg=RESERVOIR)
    return w.select(
        "store_nbr",
        "family",
        "date",
        "is_train",
        F.get("x", F.lit(0)).alias("x_first"),
        F.element_at("x", -1).alias("x_last"),
        F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("x_sum"),
        F.element_at("y", -1).alias("y_last"),
    )


@register("m10_reservoir_forecast", "store_nbr i, family s, date d, yhat f4")
def reservoir_forecast(spark, sf):
    dense = b.dense_sales(spark, sf)
    return reservoir.fit_reservoir(dense, cfg=RESERVOIR).predict(dense)


# ---- ensemble

BASE_MODELS = ("naive", "mean_28d")


@register(
    "m14_gram_sums",
    "store_nbr i, family s, nn f2, nm f2, mm f2, ny f2, my f2, yy f2, n i",
    f"""WITH {_PREDICTED} SELECT store_nbr, family, SUM(naive * naive) AS nn, SUM(naive * mean) AS nm,
      SUM(mean * mean) AS mm, SUM(naive * y) AS ny, SUM(mean * y) AS my, SUM(y * y) AS yy, COUNT(*) AS n
    FROM paired GROUP BY 1, 2""",
)
def gram_sums(spark, sf):
    sums = ensemble.gram_sums(baselines(spark, sf), BASE_MODELS, by=("store_nbr", "family"))
    pp = [F.get("pp", F.lit(i)).alias(n) for i, n in enumerate(("nn", "nm", "mm"))]
    py = [F.get("py", F.lit(i)).alias(n) for i, n in enumerate(("ny", "my"))]
    return sums.select("store_nbr", "family", *pp, *py, "yy", "n")


_OPTIMUM = f"""{_PREDICTED}, g AS (SELECT store_nbr, family, SUM((naive - mean) * (y - mean)) AS a,
    SUM((naive - mean) * (naive - mean)) AS c FROM paired GROUP BY 1, 2),
  w AS (SELECT store_nbr, family, LEAST(GREATEST(a / c, 0), 1) AS w_naive, 1 - LEAST(GREATEST(a / c, 0), 1) AS w_mean FROM g)"""


@register(
    "m14_optimal_weights",
    "store_nbr i, family s, w_naive f, w_mean f",
    f"WITH {_OPTIMUM} SELECT * FROM w",
)
def optimal_weights(spark, sf):
    weights = ensemble.optimize_weights(baselines(spark, sf), BASE_MODELS, by=("store_nbr", "family"))
    w = F.col("weights")
    return weights.select("store_nbr", "family", w["naive"].alias("w_naive"), w["mean_28d"].alias("w_mean"))


@register(
    "m15_ensemble",
    "store_nbr i, family s, window_id i, date d, y f, yhat f, lower f, upper f",
    f"""WITH {_PREDICTED}, e AS (SELECT store_nbr, family, window_id, date, MAX(y) AS y,
      SUM(CASE model WHEN 'naive' THEN 0.25 ELSE 0.5 END * yhat) / 0.75 AS yhat, STDDEV_POP(yhat) AS sd
      FROM predicted GROUP BY 1, 2, 3, 4)
    SELECT *, yhat - 1.96 * sd AS lower, yhat + 1.96 * sd AS upper FROM e""",
)
def ensemble_forecast(spark, sf):
    weights = {"naive": 0.25, "mean_28d": 0.5, "absent": 0.25}
    return ensemble.ensemble_predict(baselines(spark, sf), weights)


@register(
    "m15_ensemble_by_series",
    "store_nbr i, family s, window_id i, date d, yhat f4",
    f"""WITH {_OPTIMUM} SELECT b.store_nbr, b.family, window_id, date, w_naive * naive + w_mean * mean AS yhat
    FROM paired b JOIN w ON b.store_nbr = w.store_nbr AND b.family = w.family""",
)
def ensemble_by_series(spark, sf):
    predictions = baselines(spark, sf)
    by = ("store_nbr", "family")
    weights = ensemble.optimize_weights(predictions, BASE_MODELS, by=by)
    return ensemble.ensemble_predict(predictions, weights, by=by)


@register(
    "a19_model_spread",
    "store_nbr i, family s, window_id i, date d, spread f",
    f"""WITH {_PREDICTED} SELECT store_nbr, family, window_id, date, STDDEV_POP(yhat) AS spread
    FROM predicted GROUP BY 1, 2, 3, 4""",
)
def model_spread(spark, sf):
    rows = ensemble.ensemble_predict(baselines(spark, sf), ensemble.equal_weights(BASE_MODELS))
    return rows.withColumn("spread", (F.col("upper") - F.col("yhat")) / 1.96)


@register(
    "m16_equal_weights",
    "store_nbr i, family s, window_id i, date d, yhat f",
    f"""WITH {_PREDICTED} SELECT store_nbr, family, window_id, date, AVG(yhat) AS yhat
    FROM predicted GROUP BY 1, 2, 3, 4""",
)
def equal_weights(spark, sf):
    return ensemble.ensemble_predict(baselines(spark, sf), ensemble.equal_weights(BASE_MODELS))


@register(
    "m17_l5_model_registry",
    "type s, version s, mape f, rmse f, seq i",
    f"""WITH {_METRICS} SELECT model AS type, CAST(MAX(window_id) AS VARCHAR) AS version, ARG_MAX(mape, window_id) AS mape,
      ARG_MAX(rmse, window_id) AS rmse, CASE model WHEN 'mean_28d' THEN 3 ELSE 4 END AS seq
    FROM metrics GROUP BY model""",
)
def model_registry(spark, sf):
    """Two versions of each model registered with their errors; the later one is found."""
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    metrics = baseline_metrics(spark, sf)
    for edge in (F.min, F.max):
        pick = metrics.groupBy("model").agg(edge(F.struct("window_id", "mape", "rmse")).alias("m"))
        registry.append(
            pick.select(
                F.col("model").alias("type"),
                F.col("m.window_id").cast("string").alias("version"),
                F.create_map(F.lit("mape"), F.col("m.mape"), F.lit("rmse"), F.col("m.rmse")).alias("metrics"),
                F.lit("").alias("path"),
            )
        )
    latest = registry.latest()
    return latest.withColumns({"mape": F.col("metrics")["mape"], "rmse": F.col("metrics")["rmse"]})
