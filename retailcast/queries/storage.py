"""Files, reports and catalog tables written and read back."""

from pyspark.sql import functions as F

from retailcast.operators import features, panel
from retailcast.plans import bindings as b
from retailcast.plans import reports
from retailcast.queries.evaluation import _METRIC_SPEC, _METRICS, _REPORT, _WINDOW_SPEC, baseline_metrics, baseline_report
from retailcast.queries.quality import _RECORD_SPEC, _RECORDS, records
from retailcast.queries.registry import register
from retailcast.queries.shaping import P
from retailcast.queries.tables import HOLIDAY_ROWS, LINES, OIL, SALES, STORES, TRANSACTIONS
from retailcast.session import scratch_path
from retailcast.sources import files
from retailcast.sources.catalog import LAYERS, TableStore

_SALES_SPEC = "date d, store_nbr i, family s, sales f, onpromotion i"
_ALL_SALES = f"WITH {SALES} SELECT date, store_nbr, family, sales, onpromotion FROM sales"


def _landed(spark, sf):
    """A folder with the input tables as CSV files; there is no test file."""
    folder = scratch_path(spark, "landing")
    tables = {
        "train": b.sales(spark, sf),
        "stores": b.stores(spark, sf),
        "oil": b.oil(spark, sf),
        "holidays": b.holidays(spark, sf),
        "transactions": b.transactions(spark, sf),
    }
    for name, df in tables.items():
        files.write_csv(df, f"{folder}/{files.FILES[name][0]}")
    return folder


@register("s1_csv_scan", _SALES_SPEC, _ALL_SALES)
def csv_scan(spark, sf):
    path = scratch_path(spark, "train")
    files.write_csv(b.sales(spark, sf), path)
    return files.read_csv(spark, path, files.FILES["train"][1])


@register(
    "s2_load_tables",
    "name s, n i",
    f"""WITH {SALES}, {STORES}, {OIL}, {HOLIDAY_ROWS}, {TRANSACTIONS}
    SELECT 'train' AS name, COUNT(*) AS n FROM sales UNION ALL SELECT 'stores', COUNT(*) FROM stores
    UNION ALL SELECT 'oil', COUNT(*) FROM oil UNION ALL SELECT 'holidays', COUNT(*) FROM holidays
    UNION ALL SELECT 'transactions', COUNT(*) FROM transactions""",
)
def load_tables(spark, sf):
    loaded = files.load_store_sales_data(spark, _landed(spark, sf))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in loaded.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@register("s3_fallback_scan", _SALES_SPEC, _ALL_SALES)
def fallback_scan(spark, sf):
    folder = _landed(spark, sf)
    return files.load_sales_data(spark, f"{folder}/absent.csv", folder)


@register("s4_load_backtest_report", f"{_WINDOW_SPEC}, model s, {_METRIC_SPEC}", f"WITH {_REPORT} SELECT * FROM report")
def load_backtest_report(spark, sf):
    path = scratch_path(spark, "backtest-report")
    files.write_csv(baseline_report(spark, sf), path)
    return files.load_backtest_report(spark, path)


@register("s6_n8_anomaly_report", _RECORD_SPEC, f"WITH {_RECORDS} SELECT * FROM records")
def anomaly_report(spark, sf):
    path = scratch_path(spark, "anomaly-report")
    files.write_csv(records(spark, sf), path)
    return files.load_anomaly_report(spark, path)


@register(
    "s5_cached_view",
    "store_nbr i, n i, sales f",
    f"WITH {SALES} SELECT store_nbr, COUNT(*) AS n, SUM(sales) AS sales FROM sales GROUP BY 1",
)
def cached_view(spark, sf):
    view = files.cached_view(b.sales(spark, sf), "cached_sales")
    return view.groupBy("store_nbr").agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales"))


@register(
    "s7_forecast_export",
    "store_nbr i, family s, date d, prediction f, lower f, upper f",
    f"""WITH {SALES}, e AS (SELECT store_nbr, family, MAX(date) AS last, ARG_MAX(sales, date) AS v,
      COALESCE(STDDEV_SAMP(sales), 0) AS sd FROM sales GROUP BY 1, 2)
    SELECT store_nbr, family, CAST(last + CAST(i AS INT) AS DATE) AS date, v AS prediction,
      v - 1.96 * sd AS lower, v + 1.96 * sd AS upper FROM e, generate_series(1, 14) AS g(i)""",
)
def forecast_export(spark, sf):
    path = scratch_path(spark, "forecast")
    files.write_csv(reports.naive_band(b.sales(spark, sf), 14), path)
    schema = "store_nbr int, family string, date date, prediction double, lower double, upper double"
    return files.read_csv(spark, path, schema)


def own_store(spark):
    """A table store of its own for each run of a query."""
    path = scratch_path(spark, "layers")
    return TableStore(spark, path, f"layers_{path.rsplit('-', 1)[1]}_")


def _store(spark, sf):
    """The lines, the panel and its lags, each in its layer."""
    store = own_store(spark)
    sales = b.sales(spark, sf)
    store.store(b.sale_lines(spark, sf), "lines", "raw")
    store.store(sales, "sales", "cleaned")
    store.store(features.add_lag_features(sales, lags=(7,)), "lags", "features")
    return store


_TABLES = (("raw", "lines"), ("cleaned", "sales"), ("features", "lags"))


@register(
    "s8_s9_layer_tables",
    "layer s, name s, n i",
    f"""WITH {SALES} SELECT 'raw' AS layer, 'lines' AS name, COUNT(*) AS n FROM lines
    UNION ALL SELECT 'cleaned', 'sales', COUNT(*) FROM sales UNION ALL SELECT 'features', 'lags', COUNT(*) FROM sales""",
)
def layer_tables(spark, sf):
    store = _store(spark, sf)
    counts = [
        store.query(f"SELECT '{layer}' AS layer, '{name}' AS name, COUNT(*) AS n FROM {store.prefix}{layer}.{name}")
        for layer, name in _TABLES
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register(
    "s10_sql_over_tables",
    "store_nbr i, family s, sales f, known_lags i",
    f"""WITH {SALES}, l AS (SELECT *, LAG(sales, 7) OVER {P} AS sales_lag_7 FROM sales)
    SELECT store_nbr, family, SUM(sales) AS sales, COUNT(sales_lag_7) AS known_lags FROM l GROUP BY 1, 2""",
)
def sql_over_tables(spark, sf):
    store = _store(spark, sf)
    return store.query(
        f"SELECT s.store_nbr, s.family, SUM(s.sales) AS sales, COUNT(sales_lag_7) AS known_lags FROM {store.prefix}cleaned.sales s "
        f"JOIN {store.prefix}features.lags l ON s.date = l.date AND s.store_nbr = l.store_nbr AND s.family = l.family GROUP BY 1, 2"
    )


@register(
    "s11_table_exists",
    "layer s, present b, absent b, n i",
    f"""WITH {LINES} SELECT UNNEST(['raw', 'cleaned', 'features']) AS layer, UNNEST([TRUE, FALSE, FALSE]) AS present,
      FALSE AS absent, COUNT(*) AS n FROM lines""",
)
def table_exists(spark, sf):
    store = _store(spark, sf)
    rows = [(layer, store.exists("lines", layer), store.exists("nothing", layer)) for layer in LAYERS]
    found = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("layer", "present", "absent"), strict=True)]) for r in rows])
    return store.query(f"SELECT COUNT(*) AS n FROM {store.prefix}raw.lines").select("n", F.inline(found))


@register("s13_partitioned_by_series", _SALES_SPEC, _ALL_SALES)
def partitioned_by_series(spark, sf):
    path = scratch_path(spark, "by-series")
    files.write_partitioned(b.sales(spark, sf), path)
    return spark.read.parquet(path)


@register(
    "p11_best_flags",
    "model s, best_mape b, best_rmse b",
    f"""WITH {_METRICS}, a AS (SELECT model, AVG(mape) AS mape, AVG(rmse) AS rmse FROM metrics GROUP BY 1)
    SELECT model, mape = MIN(mape) OVER () AS best_mape, rmse = MIN(rmse) OVER () AS best_rmse FROM a""",
)
def best_flags(spark, sf):
    return reports.model_comparison(baseline_metrics(spark, sf))


@register(
    "p6_boolean_mask",
    "date d, store_nbr i, family s, sales f",
    f"""WITH {SALES}, n AS (SELECT *, COUNT(*) OVER (PARTITION BY store_nbr, family) AS n,
      ROW_NUMBER() OVER {P} AS k FROM sales) SELECT date, store_nbr, family, sales FROM n WHERE NOT k <= FLOOR(n * 0.8)""",
)
def boolean_mask(spark, sf):
    return panel.series_split(b.sales(spark, sf)).where(~F.col("is_train"))
