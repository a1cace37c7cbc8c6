from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from helpers import column, day, series
from retailcast.config import BacktestConfig, JobConfig
from retailcast.models.boosted import BoostedConfig
from retailcast.operators.registry import ModelRegistry
from retailcast.plans import jobs, reports
from retailcast.sources import files
from retailcast.sources.catalog import TableStore


def test_missing_files_are_skipped(spark, tmp_path):
    (tmp_path / "oil.csv").write_text("date,dcoilwtico\n2023-01-01,50.5\n2023-01-02,\n")
    found = files.load_store_sales_data(spark, str(tmp_path))
    assert list(found) == ["oil"]
    assert column(found["oil"], "dcoilwtico") == [50.5, None]


def test_columns_are_matched_by_name_and_bad_values_become_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sales,store_nbr,date,extra\n1.5,2,2023-01-01,x\nNaN,oops,2023-01-02,y\n")
    df = files.read_csv(spark, str(tmp_path / "t.csv"), files.FILES["train"][1])
    rows = df.orderBy("date").collect()
    assert (rows[0]["sales"], rows[0]["store_nbr"], rows[0]["extra"]) == (1.5, 2, "x")
    assert (rows[1]["sales"], rows[1]["store_nbr"]) == (None, None)


def test_sales_fall_back_to_an_empty_table(spark, tmp_path):
    empty = files.load_sales_data(spark, str(tmp_path / "no.csv"), str(tmp_path))
    assert empty.columns == ["date", "store_nbr", "family", "sales"] and empty.count() == 0
    (tmp_path / "train.csv").write_text("date,store_nbr,family,sales\n2023-01-01,1,A,2\n")
    assert files.load_sales_data(spark, None, str(tmp_path)).count() == 1


def test_absent_reports_are_empty(spark, tmp_path):
    assert files.load_backtest_report(spark, str(tmp_path / "b.csv")).count() == 0
    assert files.load_anomaly_report(spark, str(tmp_path / "a.csv")).count() == 0


def test_partition_folders_hold_awkward_names(spark, tmp_path):
    df = series(spark, [1, 2], family="A/B C").union(series(spark, [3], store=2))
    files.write_partitioned(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted((r["family"], r["sales"]) for r in back.collect()) == [("A", 3), ("A/B C", 1), ("A/B C", 2)]


def test_table_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "layers"), "store_test_")
    store.store(series(spark, [1, 2]), "s")
    assert store.exists("s") and not store.exists("s", "cleaned") and not store.exists("none")
    store.store(series(spark, [1, 2, 3]), "s")
    assert store.query("SELECT COUNT(*) AS n FROM store_test_raw.s").first()["n"] == 3
    with pytest.raises(ValueError):
        store.store(series(spark, [1]), "s", "other")


def test_registry_returns_the_last_appended(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "r"))
    assert registry.latest("additive").count() == 0
    registry.register("additive", "2", {"rmse": 1}, "p2")
    registry.register("additive", "1", {"rmse": 2}, "p1")
    registry.register("boosted", "1", {}, "q")
    again = ModelRegistry(spark, str(tmp_path / "r"))
    row = again.latest("additive").first()
    assert (row["version"], row["metrics"], row["path"]) == ("1", {"rmse": 2.0}, "p1")
    assert again.latest().count() == 2 and again.entries().count() == 3


def test_registry_of_several_writers(spark, tmp_path):
    """Appends of two sessions at the same time: no number is shared, none is lost, each writer's order holds."""
    path = str(tmp_path / "r")

    def write(k):
        registry = ModelRegistry(spark.newSession(), path)
        for i in range(5):
            registry.register(f"writer{k}", str(i), {"i": i}, "p")

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    rows = ModelRegistry(spark, path).entries().orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 11))
    for k in range(2):
        assert [r["version"] for r in rows if r["type"] == f"writer{k}"] == list("01234")
    registry = ModelRegistry(spark, path)
    registry.append(registry.entries().where("seq < 0"))
    assert registry.entries().count() == 10
    assert files.create_once(spark, f"{path}/once", "a") and not files.create_once(spark, f"{path}/once", "b")
    assert spark.read.text(f"{path}/once").first()[0] == "a"


def test_anomaly_page(spark):
    rows = [("2023-01-01", 1, "A", 9.0, "iqr", "cap", 5.0), ("2023-01-02", 2, "A", 9.0, "isolation_forest", "cap", 5.0)]
    records = spark.createDataFrame(rows, files.ANOMALY_SCHEMA)
    assert [r["date"] for r in reports.anomaly_details(records, store="All").collect()] == ["2023-01-02", "2023-01-01"]
    assert reports.anomaly_details(records, method="iqr").count() == 1
    assert reports.anomaly_rollup(records).where("store_nbr is null").first()["n"] == 2


@pytest.fixture(scope="module")
def job_config(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    values = [20 + 5 * (i % 7) + (200 if i == 77 else 0) for i in range(150)]
    sales = series(spark, values).union(series(spark, values, store=2, family="B/C"))
    files.write_csv(sales.withColumn("onpromotion", F.lit(0)), f"{root}/raw/train.csv")
    holidays = spark.createDataFrame([(day(3), "Holiday", "Fair")], "date date, type string, description string")
    files.write_csv(holidays, f"{root}/raw/holidays_events.csv")
    bt = BacktestConfig(train_window_months=3, test_window_days=7, step_days=14, min_train_samples=50)
    return JobConfig(raw_path=f"{root}/raw", report_path=f"{root}/reports", lookback=14, backtest=bt)


def test_train_job(spark, job_config, tmp_path):
    boost = BoostedConfig(n_estimators=2, max_depth=2)
    registry = jobs.train(spark, job_config, str(tmp_path), boost=boost)
    assert {r["type"] for r in registry.latest().collect()} == {"additive", "boosted", "sequence"}
    with pytest.raises(ValueError):
        jobs.train(spark, job_config, str(tmp_path), models="other")


def test_detect_job(spark, job_config):
    run = jobs.detect(spark, job_config)
    assert run.records.count() == 2
    assert files.load_anomaly_report(spark, f"{job_config.report_path}/anomaly_report.csv").count() == 2
    assert run.repaired.agg(F.max("sales")).first()[0] < 100


def test_backtest_job(spark, job_config):
    run = jobs.backtest(spark, job_config)
    assert {r["model"] for r in run.aggregates.collect()} == {"naive", "mean_28d", "additive"}
    assert run.pair_tests.count() == 3
    assert files.load_backtest_report(spark, f"{job_config.report_path}/backtest_report.csv").count() == run.report.count()


def test_prepare_job_fills_the_layers(spark, job_config, tmp_path):
    store = TableStore(spark, str(tmp_path / "layers"), "prepare_test_")
    done = jobs.prepare(spark, job_config, store)
    assert done.validation.first()["is_valid"]
    assert done.features.count() == done.merged.count() == 300
    assert {"is_holiday_holiday", "sales_lag_28"} <= set(done.features.columns)
    assert done.seasonality.count() == 2


def test_ensemble_of_a_backtest(spark, job_config):
    run = jobs.backtest(spark, job_config)
    ens = jobs.ensemble_backtest(run, ("additive", "naive", "mean_28d"))
    assert all(sum(r["weights"].values()) == pytest.approx(1) for r in ens.weights.collect())
    early = {r["window_id"] for r in ens.metrics.collect()}
    assert early and min(early) > 0


def test_forecast_job(spark, job_config):
    sales = files.load_sales_data(spark, None, job_config.raw_path)
    out = jobs.forecast(spark, sales, job_config)
    assert out.groupBy("store_nbr").count().collect()[0]["count"] == 7
    assert out.where("not (lower <= yhat and yhat <= upper)").count() == 0


def test_registry_before_its_first_commit(spark, tmp_path):
    """Another writer has made the log's folder, and not yet a commit."""
    (tmp_path / "r" / "log").mkdir(parents=True)
    registry = ModelRegistry(spark, str(tmp_path / "r"))
    assert registry.entries().count() == 0
    registry.register("a", "1", {"m": 1.0}, "p")
    assert registry.latest("a").first()["seq"] == 1
