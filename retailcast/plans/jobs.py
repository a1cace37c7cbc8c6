"""The batch jobs: prepare tables, train the forecasters, forecast, detect anomalies, backtest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailcast import KEYS
from retailcast.config import JobConfig
from retailcast.models.additive import backtest_model, fit_additive, predict_additive
from retailcast.models.boosted import BoostedConfig, fit_boosted
from retailcast.models.sequence import SequenceConfig, fit_sequence
from retailcast.models.series_boosted import SeriesBoosters, fit_series_boosters
from retailcast.operators.anomaly import anomaly_records, detect_anomalies, handle_anomalies
from retailcast.operators.backtest import (
    Model,
    aggregate_metrics,
    backtest_report,
    backtest_windows,
    baseline_predictions,
    diebold_mariano,
    flat_report,
    model_predictions,
    window_metrics,
)
from retailcast.operators.ensemble import ensemble_predict, equal_weights, optimize_weights
from retailcast.operators.features import engineer_all_features
from retailcast.operators.joins import merge_sources
from retailcast.operators.panel import daily_panel, daily_total, filter_rows
from retailcast.operators.quality import validate_sales_data
from retailcast.operators.registry import ModelRegistry
from retailcast.operators.seasonality import analyze
from retailcast.session import scratch_path
from retailcast.sources.catalog import TableStore
from retailcast.sources.files import load_store_sales_data, write_csv

MODEL_CHOICES = ("all", "additive", "boosted", "sequence")


def feature_table(tables: Mapping[str, DataFrame], stores: Sequence[int] | None = None) -> DataFrame:
    """Features of the merged input tables, for all stores or the given ones."""
    merged = merge_sources(tables["train"], tables.get("stores"), tables.get("oil"), tables.get("transactions"))
    kept = filter_rows(merged, store_nbr=list(stores) if stores else None)
    return engineer_all_features(kept, tables.get("holidays"))


@dataclass
class PreparedTables:
    validation: DataFrame
    merged: DataFrame
    features: DataFrame
    seasonality: DataFrame


def prepare(spark: SparkSession, cfg: JobConfig, store: TableStore) -> PreparedTables:
    """Land the inputs in the raw layer, validate and merge them, and store the features.

    Each layer is read back from its table, so that a later step does not repeat an earlier one.
    """
    for name, df in load_store_sales_data(spark, cfg.raw_path).items():
        store.store(df, name, "raw")
    raw = {n: store.table(n, "raw") for n in ("train", "stores", "oil", "holidays", "transactions") if store.exists(n, "raw")}
    merged = merge_sources(raw["train"], raw.get("stores"), raw.get("oil"), raw.get("transactions"))
    store.store(merged, "sales", "cleaned")
    cleaned = store.table("sales", "cleaned")
    store.store(engineer_all_features(cleaned, raw.get("holidays")), "sales", "features")
    return PreparedTables(
        validate_sales_data(raw["train"]), cleaned, store.table("sales", "features"), analyze(daily_panel(cleaned))
    )


def train(
    spark: SparkSession,
    cfg: JobConfig,
    model_path: str,
    models: str = "all",
    version: str = "1",
    stores: Sequence[int] | None = None,
    boost: BoostedConfig = BoostedConfig(),
    boost_scope: str = "series",
) -> ModelRegistry:
    """Fit and save the chosen forecasters over all series and register what was saved.

    The horizon is the first configured one. A forecaster with nothing to fit is skipped. Boosted trees are fitted for
    every series, or with ``boost_scope="pooled"`` once for all of them.
    """
    if models not in MODEL_CHOICES:
        raise ValueError(f"unknown models: {models}")
    if boost_scope not in ("series", "pooled"):
        raise ValueError(f"unknown scope: {boost_scope}")
    tables = load_store_sales_data(spark, cfg.raw_path)
    registry = ModelRegistry(spark, f"{model_path}/registry")
    horizon = cfg.horizons[0]
    features = feature_table(tables, stores)
    if models in ("all", "additive"):
        path = f"{model_path}/additive/{version}"
        fit_additive(features, holidays=tables.get("holidays")).write.mode("overwrite").parquet(path)
        fitted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.avg("sigma").alias("s")).first()
        registry.register("additive", version, {"series": fitted["n"], "sigma": fitted["s"] or 0.0}, path)
    if models in ("all", "boosted"):
        path = f"{model_path}/boosted/{version}"
        if boost_scope == "series":
            fit_series_boosters(features, min_rows=cfg.min_series_rows, cfg=boost).save(path)
            kept = SeriesBoosters.load(path).rounds().where("best")
            fitted = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("round").alias("trees"), F.avg("valid_rmse").alias("rmse")).first()
            if fitted["n"]:
                registry.register("boosted", version, {"series": fitted["n"], "trees": fitted["trees"], "rmse": fitted["rmse"]}, path)
    if models in ("all", "boosted") and boost_scope == "pooled":
        path = f"{model_path}/boosted/{version}"
        model = fit_boosted(features, min_rows=cfg.min_series_rows, cfg=boost)
        if model is not None:
            model.save(path)
            registry.register("boosted", version, {"trees": model.pipeline.stages[-1].getNumTrees}, path)
    if models in ("all", "sequence"):
        path = f"{model_path}/sequence/{version}"
        total = daily_total(filter_rows(tables["train"], store_nbr=list(stores) if stores else None))
        model = fit_sequence(total, keys=(), cfg=SequenceConfig(lookback=cfg.lookback, horizon=horizon))
        if model is not None:
            model.save(spark, path)
            losses = [step[3] for step in model.history if step[4]]
            registry.register("sequence", version, {"val_loss": losses[0]}, path)
    return registry


@dataclass
class AnomalyRun:
    detected: DataFrame
    repaired: DataFrame
    records: DataFrame


def detect(
    spark: SparkSession,
    cfg: JobConfig,
    strategy: str = "interpolate",
    features: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    stores: Sequence[int] | None = None,
) -> AnomalyRun:
    """Detect and repair anomalies of the sales file and write the report of the records."""
    sales = load_store_sales_data(spark, cfg.raw_path)["train"]
    kept = filter_rows(sales, store_nbr=list(stores) if stores else None)
    detected = detect_anomalies(
        kept,
        multivariate_features=features,
        multiplier=cfg.iqr_multiplier,
        contamination=cfg.contamination,
        keys=keys,
    )
    records = anomaly_records(detected, strategy, keys=keys)
    write_csv(records, f"{cfg.report_path}/anomaly_report.csv")
    return AnomalyRun(detected, handle_anomalies(detected, strategy, keys=keys), records)


@dataclass
class BacktestRun:
    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame
    aggregates: DataFrame
    pair_tests: DataFrame


def backtest_panel(
    spark: SparkSession,
    panel: DataFrame,
    cfg: JobConfig,
    models: Mapping[str, Model] | None = None,
    keys: Sequence[str] = KEYS,
) -> BacktestRun:
    """Backtest the two baselines and the given models over every series of a panel.

    The predictions are written once to the shared folder, since the metrics, the report
    and the pair tests all read them.
    """
    chosen = {"additive": backtest_model()} if models is None else models
    cells = baseline_predictions(panel, keys, cfg=cfg.backtest).withColumn("error", F.lit(None).cast("string"))
    if chosen:
        cells = cells.unionByName(model_predictions(panel, chosen, keys, cfg=cfg.backtest))
    path = scratch_path(spark, "predictions")
    cells.write.parquet(path)
    predictions = spark.read.parquet(path)
    metrics = window_metrics(predictions, keys)
    report = backtest_report(metrics, backtest_windows(panel, keys, cfg=cfg.backtest), keys)
    usable = predictions.where(F.col("error").isNull())
    names = sorted(["naive", "mean_28d", *chosen])
    return BacktestRun(
        predictions, metrics, report, aggregate_metrics(metrics), diebold_mariano(usable, names, keys)
    )


def backtest(
    spark: SparkSession,
    cfg: JobConfig,
    models: Mapping[str, Model] | None = None,
) -> BacktestRun:
    """Backtest the sales file and write the flat report."""
    sales = load_store_sales_data(spark, cfg.raw_path)["train"]
    run = backtest_panel(spark, daily_panel(sales), cfg, models)
    write_csv(flat_report(run.report), f"{cfg.report_path}/backtest_report.csv")
    return run


@dataclass
class EnsembleRun:
    weights: DataFrame
    predictions: DataFrame
    metrics: DataFrame


def ensemble_backtest(
    run: BacktestRun, models: Sequence[str], keys: Sequence[str] = KEYS, validation_share: float = 0.5
) -> EnsembleRun:
    """Weights per series from the first windows of a backtest, scored on the later ones.

    Windows up to ``validation_share`` of a series' own last id choose its weights. Windows overlap, so
    the first scored ones share test days with the last that chose.
    """
    cells = run.predictions.where(F.col("error").isNull() & F.col("model").isin(*models))
    # window ids count from each series' own start; a series holds a bounded number of predictions
    last = F.max("window_id").over(Window.partitionBy(*keys))
    cells = cells.withColumn("_first", F.col("window_id") <= F.floor(last * F.lit(validation_share)))
    weights = optimize_weights(cells.where("_first").drop("_first"), models, keys, by=keys)
    later = cells.where(~F.col("_first")).drop("_first")
    combined = ensemble_predict(later, weights, keys, by=keys).withColumn("model", F.lit("ensemble"))
    return EnsembleRun(weights, combined, window_metrics(combined, keys))


def forecast(
    spark: SparkSession,
    panel: DataFrame,
    cfg: JobConfig,
    holidays: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
    keys: Sequence[str] = KEYS,
    boost: BoostedConfig = BoostedConfig(),
) -> DataFrame:
    """The next days of every series: additive, sequence and boosted forecasts and their weighted mean.

    The horizon is the first configured one; rows are (keys, date, yhat, lower, upper). Boosted trees roll forward day by day.
    """
    horizon, path = cfg.horizons[0], scratch_path(spark, "additive")
    fit_additive(panel, keys, holidays=holidays).write.parquet(path)
    additive = predict_additive(spark.read.parquet(path), horizon, keys, holidays=holidays)
    parts = additive.select(*keys, F.col("ds").alias("date"), F.lit("additive").alias("model"), "yhat")
    model = fit_sequence(panel, keys, cfg=SequenceConfig(lookback=cfg.lookback, horizon=horizon))
    if model is not None:
        sequence = model.predict(panel).select(*keys, "date", F.lit("sequence").alias("model"), "yhat")
        parts = parts.unionByName(sequence)
    path = scratch_path(spark, "features")
    engineer_all_features(panel, holidays, keys=keys).write.parquet(path)
    boosters = fit_series_boosters(spark.read.parquet(path), keys=keys, min_rows=cfg.min_series_rows, cfg=boost)
    ahead = boosters.roll_forward(panel, horizon, holidays)
    parts = parts.unionByName(ahead.select(*keys, "date", F.lit("boosted").alias("model"), "yhat"))
    return ensemble_predict(parts, weights or equal_weights(), keys)
