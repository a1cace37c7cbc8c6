"""The batch jobs, run on input files landed from the driver's tables."""

from pyspark.sql import functions as F

from retailcast.config import JobConfig
from retailcast.operators.backtest import window_metrics
from retailcast.plans import bindings as b
from retailcast.plans import jobs
from retailcast.queries.evaluation import _PREDICTED, BASE_MODELS, last_week
from retailcast.queries.quality import _flagged_sql
from retailcast.queries.registry import register
from retailcast.queries.storage import _landed, own_store
from retailcast.queries.tables import SALES
from retailcast.session import scratch_path


def _config(spark, sf, **more):
    return JobConfig(raw_path=_landed(spark, sf), report_path=scratch_path(spark, "reports"), **more)


@register("m18_train_job", "type s, version s, n_metrics i")
def train_job(spark, sf):
    registry = jobs.train(spark, _config(spark, sf), scratch_path(spark, "models"))
    return registry.latest().withColumn("n_metrics", F.size("metrics"))


@register(
    "n8_detection_job",
    "store_nbr i, family s, n i, total f",
    f"""WITH {_flagged_sql(False)} SELECT store_nbr, family, COUNT(*) AS n, SUM(sales) AS total
    FROM flagged WHERE anomaly_iqr GROUP BY 1, 2""",
)
def detection_job(spark, sf):
    records = jobs.detect(spark, _config(spark, sf)).records
    return records.groupBy("store_nbr", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("original_value").alias("total"))


@register(
    "b2_backtest_job",
    "model s, mape_mean f, rmse_mean f, mae_mean f, smape_mean f",
    f"""WITH {SALES}, st AS (SELECT store_nbr, family, date, sales, ROW_NUMBER() OVER k AS n,
      AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS mean
      FROM sales WINDOW k AS (PARTITION BY store_nbr, family ORDER BY date)),
    r AS (SELECT store_nbr, family, MAX(date) AS hi, CAST(MIN(date) + INTERVAL 12 MONTH AS DATE) AS first FROM sales GROUP BY 1, 2),
    w AS (SELECT store_nbr, family, i AS window_id, CAST(first + CAST(7 * i AS INT) AS DATE) AS train_end
      FROM r, generate_series(0, 4000) AS g(i) WHERE first + CAST(7 * i + 28 AS INT) <= hi),
    tr AS (SELECT w.*, s.n, s.sales AS naive, s.mean FROM w ASOF JOIN st s
      ON w.store_nbr = s.store_nbr AND w.family = s.family AND w.train_end >= s.date),
    lw AS (SELECT tr.store_nbr, tr.family, window_id, isodow(z.date) AS wd, ARG_MAX(z.sales, z.n) AS yhat FROM tr JOIN st z
      ON tr.store_nbr = z.store_nbr AND tr.family = z.family AND z.n BETWEEN tr.n - 6 AND tr.n GROUP BY 1, 2, 3, 4),
    tested AS (SELECT d.store_nbr, d.family, window_id, d.date, d.sales AS y, naive, mean FROM tr JOIN sales d
      ON tr.store_nbr = d.store_nbr AND tr.family = d.family AND d.date BETWEEN train_end + 1 AND train_end + 28
      WHERE n >= 365),
    predicted AS (SELECT store_nbr, family, window_id, 'naive' AS model, y, naive AS yhat FROM tested
      UNION ALL SELECT store_nbr, family, window_id, 'mean_28d', y, mean FROM tested
      UNION ALL SELECT t.store_nbr, t.family, t.window_id, 'last_week', y, yhat FROM tested t LEFT JOIN lw
        ON t.store_nbr = lw.store_nbr AND t.family = lw.family AND t.window_id = lw.window_id AND isodow(t.date) = wd),
    m AS (SELECT store_nbr, family, window_id, model,
      COALESCE(AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100, 0) AS mape, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse,
      AVG(ABS(y - yhat)) AS mae, COALESCE(AVG(CASE WHEN ABS(y) + ABS(yhat) <> 0
        THEN ABS(y - yhat) / ((ABS(y) + ABS(yhat)) / 2) END) * 100, 0) AS smape FROM predicted GROUP BY 1, 2, 3, 4)
    SELECT model, AVG(mape) AS mape_mean, AVG(rmse) AS rmse_mean, AVG(mae) AS mae_mean, AVG(smape) AS smape_mean
    FROM m GROUP BY 1""",
)
def backtest_job(spark, sf):
    return jobs.backtest(spark, _config(spark, sf), {"last_week": last_week}).aggregates


@register(
    "s9_prepare_job",
    "is_valid b, n_raw i, n_merged i, n_features i, n_series i, known_lags i",
    f"""WITH {SALES}, l AS (SELECT LAG(sales, 365) OVER (PARTITION BY store_nbr, family ORDER BY date) AS lagged FROM sales),
    n AS (SELECT COUNT(*) AS n, COUNT(DISTINCT (store_nbr, family)) AS s,
      COUNT(DISTINCT date) = MAX(date) - MIN(date) + 1 AS ok FROM sales)
    SELECT ok AS is_valid, n AS n_raw, n AS n_merged, n AS n_features, s AS n_series,
      (SELECT COUNT(lagged) FROM l) AS known_lags FROM n""",
)
def prepare_job(spark, sf):
    store = own_store(spark)
    done = jobs.prepare(spark, _config(spark, sf), store)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar()
    return done.validation.select(
        "is_valid",
        count(store.table("train"), "n").alias("n_raw"),
        count(done.merged, "n").alias("n_merged"),
        count(done.features, "n").alias("n_features"),
        count(done.seasonality, "n").alias("n_series"),
        done.features.agg(F.count("sales_lag_365")).scalar().alias("known_lags"),
    )


@register(
    "m15_ensemble_job",
    "window_id i, rmse f, mae f, n_scored i",
    f"""WITH {_PREDICTED}, last AS (SELECT FLOOR(MAX(window_id) * 0.5) AS cut FROM paired),
    g AS (SELECT store_nbr, family, SUM((naive - mean) * (y - mean)) AS a, SUM((naive - mean) * (naive - mean)) AS c
      FROM paired, last WHERE window_id <= cut GROUP BY 1, 2),
    e AS (SELECT window_id, y, LEAST(GREATEST(a / c, 0), 1) * naive + (1 - LEAST(GREATEST(a / c, 0), 1)) * mean AS yhat
      FROM paired p JOIN g ON p.store_nbr = g.store_nbr AND p.family = g.family, last WHERE window_id > cut)
    SELECT window_id, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse, AVG(ABS(y - yhat)) AS mae, COUNT(*) AS n_scored
    FROM e GROUP BY 1""",
)
def ensemble_job(spark, sf):
    cfg = JobConfig()
    run = jobs.backtest_panel(spark, b.dense_sales(spark, sf), cfg, models={})
    # all series together; their windows begin on the same days
    return window_metrics(jobs.ensemble_backtest(run, BASE_MODELS).predictions)


@register("m15_forecast_job", "store_nbr i, family s, date d, yhat f4, lower f4, upper f4")
def forecast_job(spark, sf):
    dense = b.dense_sales(spark, sf).persist()
    return jobs.forecast(spark, dense, JobConfig(), holidays=b.holidays(spark, sf))
