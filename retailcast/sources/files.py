"""CSV files with explicit schemas: inputs that may be absent, and reports."""

from __future__ import annotations

import logging
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.operators.anomaly import REPORT_SCHEMA as ANOMALY_SCHEMA

logger = logging.getLogger(__name__)

# fixed values: file name and schema of each input
FILES = {
    "train": ("train.csv", "id bigint, date date, store_nbr int, family string, sales double, onpromotion int"),
    "test": ("test.csv", "id bigint, date date, store_nbr int, family string, onpromotion int"),
    "stores": ("stores.csv", "store_nbr int, city string, state string, type string, cluster int"),
    "oil": ("oil.csv", "date date, dcoilwtico double"),
    "holidays": (
        "holidays_events.csv",
        "date date, type string, locale string, locale_name string, description string, transferred boolean",
    ),
    "transactions": ("transactions.csv", "date date, store_nbr int, transactions bigint"),
}
SALES_SCHEMA = "date date, store_nbr int, family string, sales double"
BACKTEST_SCHEMA = (
    "window_id bigint, train_start date, train_end date, test_start date, test_end date, "
    "model string, mape double, rmse double, mae double, smape double"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the file system its path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text, whole and at once; False if it is there already.

    The text is written beside it first. A rename does not replace a file, except on a local disk, where a hard link is made instead.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return bool(fs.rename(draft, target))
        files, paths = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
        try:
            files.createLink(paths.get(fs.makeQualified(target).toUri()), paths.get(fs.makeQualified(draft).toUri()))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def null_nan(df: DataFrame) -> DataFrame:
    """Null in place of NaN, so that aggregates skip it."""
    nulls: dict[str, Column] = {
        n: F.nanvl(F.col(n), F.lit(None).cast(t)) for n, t in df.dtypes if t in ("double", "float")
    }
    return df.withColumns(nulls) if nulls else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header. Columns are matched by name; those the schema does not
    name stay strings, and values that do not parse become null.
    """
    raw = spark.read.option("header", True).csv(path)
    if schema is None:
        return raw
    types = dict(part.strip().split(" ", 1) for part in schema.split(","))
    if all(c in types for c in raw.columns):
        wanted = ", ".join(f"`{c}` {types[c]}" for c in raw.columns)
        return null_nan(spark.read.schema(wanted).option("header", True).option("enforceSchema", False).csv(path))
    casts = [
        F.expr(f"try_cast(`{c}` AS {types[c]})").alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns
    ]
    return null_nan(raw.select(*casts))


def load_store_sales_data(spark: SparkSession, data_path: str) -> dict[str, DataFrame]:
    """The input tables found in a folder; a missing file is skipped with a warning."""
    found = {}
    for name, (file_name, schema) in FILES.items():
        path = f"{data_path.rstrip('/')}/{file_name}"
        if path_exists(spark, path):
            found[name] = read_csv(spark, path, schema)
        else:
            logger.warning("file not found: %s", path)
    return found


def load_sales_data(spark: SparkSession, csv_path: str | None = None, raw_path: str = "data/raw") -> DataFrame:
    """Sales from an explicit file, else from the raw folder, else an empty table."""
    for path in (csv_path, f"{raw_path.rstrip('/')}/train.csv"):
        if path and path_exists(spark, path):
            return read_csv(spark, path, FILES["train"][1])
    return spark.createDataFrame([], SALES_SCHEMA)


def _optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path_exists(spark, path):
        return read_csv(spark, path, schema)
    return spark.createDataFrame([], schema)


def load_backtest_report(spark: SparkSession, path: str = "data/reports/backtest_report.csv") -> DataFrame:
    return _optional(spark, path, BACKTEST_SCHEMA)


def load_anomaly_report(spark: SparkSession, path: str = "data/reports/anomaly_report.csv") -> DataFrame:
    return _optional(spark, path, ANOMALY_SCHEMA)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a folder of CSV parts with headers, replacing what was there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("store_nbr", "family")) -> None:
    """Parquet in one folder per key; Spark escapes what a folder name cannot hold.

    Rows are brought together by key first, so that a folder gets few files; rebalancing
    splits a key that is too large for one task.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def cached_view(df: DataFrame, name: str) -> DataFrame:
    """Register a frame as a cached view for repeated report queries."""
    df.createOrReplaceTempView(name)
    view = df.sparkSession.table(name)
    view.cache()
    return view
