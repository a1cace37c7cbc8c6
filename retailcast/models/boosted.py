"""Boosted trees on engineered features, one model pooled over all series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast import DATE, KEYS, TARGET
from retailcast.operators.features import feature_columns, finite
from retailcast.operators.panel import min_group_size, series_split
from retailcast.session import shared_dir
from retailcast.sources.files import path_exists


@dataclass(frozen=True)
class BoostedConfig:
    """Settings of both boosters; the defaults are fixed values that existing users rely on."""

    n_estimators: int = 1000
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_rows: int = 1
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    patience: int | None = 50  # rounds without a gain on the validation rows; None keeps all rounds
    bins: int = 64
    checkpoint_interval: int = 10
    seed: int = 42


def _inputs(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[finite(n).alias(n) for n in names])


@dataclass
class BoostedModel:
    """A fitted pipeline, its feature names and the series it may score."""

    pipeline: PipelineModel | None
    features: list[str]
    series: DataFrame | None = None
    errors: tuple[float, ...] = ()  # validation RMSE of every round run

    def known_rows(self, df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
        """The rows of trained series, all rows if the model names no series."""
        return df if self.series is None else df.join(self.series, list(keys), "left_semi")

    def predict(self, df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
        """(date, keys, prediction) for the rows of trained series; empty when there are none."""
        scored = self.pipeline.transform(_inputs(self.known_rows(df, keys), self.features, (date, *keys)))
        return scored.select(date, *keys, "prediction")

    def importances(self) -> DataFrame:
        """(feature, importance), a share of 1 for each feature."""
        values = self.pipeline.stages[-1].featureImportances.toArray()
        rows = [(n, float(v)) for n, v in zip(self.features, values, strict=True)]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")

    def top_features(self, n: int = 20) -> DataFrame:
        return self.importances().orderBy(F.col("importance").desc(), "feature").limit(n)

    def save(self, path: str) -> None:
        """The pipeline, its feature names and its series, each in a folder under ``path``."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        names = [(i, n) for i, n in enumerate(self.features)]
        SparkSession.active().createDataFrame(names, "at int, name string").write.mode("overwrite").parquet(f"{path}/features")
        if self.series is not None:
            self.series.write.mode("overwrite").parquet(f"{path}/series")

    @classmethod
    def load(cls, path: str) -> BoostedModel:
        spark = SparkSession.active()
        names = [r["name"] for r in spark.read.parquet(f"{path}/features").orderBy("at").collect()]
        series = spark.read.parquet(f"{path}/series") if path_exists(spark, f"{path}/series") else None
        return cls(PipelineModel.load(f"{path}/pipeline"), names, series)


def fit_boosted(
    df: DataFrame,
    target: str = TARGET,
    exclude: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    min_rows: int = 100,
    cfg: BoostedConfig = BoostedConfig(),
) -> BoostedModel | None:
    """Fit on the first 80 % of every series of at least ``min_rows`` rows; None without any.

    The last 20 % is the validation set that chooses the number of trees: boosting ends when its error has not fallen for
    ``patience`` rounds and returns to the best round; without patience all rounds are kept. Trees do not depend on
    how many follow, so rounds are asked for in growing runs. Histograms are aggregated over the cluster; no task holds a series.
    """
    shared_dir(df.sparkSession)  # the boosting cuts its lineage there
    names = feature_columns(df, target, exclude)
    known = df.where(F.col(target).isNotNull())
    split = series_split(min_group_size(known, keys, min_rows), keys, date)
    label = F.col(target).cast("double")
    rows = split.select(*keys, label.alias("_label"), (~F.col("is_train")).alias("_valid"), *[finite(n).alias(n) for n in names])
    rows = rows.persist()
    series = rows.select(*keys).distinct()
    if rows.isEmpty():
        rows.unpersist()
        return None
    assembler = VectorAssembler(inputCols=names, outputCol="_features")
    rows_in = assembler.transform(rows).select("_features", "_label", "_valid").persist()
    train, valid = rows_in.where(~F.col("_valid")), rows_in.where("_valid")

    def fit(rounds: int) -> GBTRegressionModel:
        booster = GBTRegressor(
            featuresCol="_features",
            labelCol="_label",
            predictionCol="prediction",
            maxIter=rounds,
            maxDepth=cfg.max_depth,
            stepSize=cfg.learning_rate,
            subsamplingRate=cfg.subsample,
            featureSubsetStrategy=str(cfg.colsample),
            minInstancesPerNode=cfg.min_child_rows,
            checkpointInterval=cfg.checkpoint_interval,
            seed=cfg.seed,
        )
        return booster.fit(train)

    asked = cfg.n_estimators if cfg.patience is None else min(cfg.n_estimators, 2 * cfg.patience)
    while True:
        model = fit(asked)
        errors = [e**0.5 for e in model.evaluateEachIteration(valid, "squared")] if not valid.isEmpty() else []
        best, ended = best_round(errors, cfg.patience)
        if ended or asked == cfg.n_estimators:
            break
        asked = min(cfg.n_estimators, 2 * asked)
    kept = first_trees(model, best if errors else asked)
    rows_in.unpersist()
    rows.unpersist()
    return BoostedModel(PipelineModel([assembler, kept]), names, series, tuple(errors))


def best_round(errors: Sequence[float], patience: int | None) -> tuple[int, bool]:
    """The round to return to, and whether ``patience`` rounds without a lower error have passed since."""
    if patience is None:
        return len(errors), True
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` rounds."""
    if n >= model.getNumTrees:
        return model
    java = model._java_obj
    jvm = SparkSession.active().sparkContext._jvm
    trees = java.trees()
    some = SparkSession.active().sparkContext._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    for k in range(n):
        some[k] = trees[k]
    weights = jvm.java.util.Arrays.copyOf(java.treeWeights(), n)
    short = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), some, weights, java.numFeatures())
    out = GBTRegressionModel(java.copyValues(short, java.extractParamMap()))
    out._transfer_params_from_java()
    return out
