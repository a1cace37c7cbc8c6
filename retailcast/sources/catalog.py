"""Tables in the three data layers, kept in the Spark catalog."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

LAYERS = ("raw", "cleaned", "features")


class TableStore:
    """Named tables in the layers raw, cleaned and features. Stores with different prefixes share nothing.

    The databases of a prefix keep the folder they were made in; another ``root`` for the prefix is an error.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, prefix: str = "") -> None:
        self.spark, self.prefix = spark, prefix
        for layer in LAYERS:
            folder = f"{root.rstrip('/')}/{layer}" if root else None
            place = f" LOCATION '{folder}'" if folder else ""
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{layer}{place}")
            if folder and not _same_place(spark.catalog.getDatabase(f"{prefix}{layer}").locationUri, folder):
                raise ValueError(f"the tables of {prefix}{layer} lie elsewhere, not below {root}")

    def _name(self, table: str, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer: {layer}")
        return f"{self.prefix}{layer}.`{table}`"

    def store(self, df: DataFrame, table: str, layer: str = "raw") -> None:
        """Create the table, or replace it with the frame."""
        df.write.mode("overwrite").saveAsTable(self._name(table, layer))

    def table(self, table: str, layer: str = "raw") -> DataFrame:
        return self.spark.table(self._name(table, layer))

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def exists(self, table: str, layer: str = "raw") -> bool:
        return self.spark.catalog.tableExists(self._name(table, layer))


def _same_place(uri: str, folder: str) -> bool:
    """Whether a database's location is the folder; a folder without a scheme has the default one."""
    a, b = urlparse(uri), urlparse(folder)
    schemes = not b.scheme or (a.scheme, a.netloc) == (b.scheme, b.netloc)
    return schemes and a.path.rstrip("/") == b.path.rstrip("/")
