"""Versions of fitted models with their metrics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.sources.files import create_once, path_exists

SCHEMA = "seq bigint, type string, version string, metrics map<string,double>, path string, timestamp timestamp"


class ModelRegistry:
    """An append-only table in a folder that several writers may append to.

    An append writes its rows to a folder of its own and then commits by creating the next file of a log, which only one
    writer can do; the others read the log again and take the number after it. The order of the log is the order of the
    entries. Rows that were never committed are not read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _commits(self) -> list[tuple[str, int, int]]:
        """(folder of the rows, entries before, entries) of every commit, in order."""
        if not path_exists(self.spark, f"{self.path}/log"):
            return []
        # the folder may be there before its first commit
        logged = self.spark.read.option("pathGlobFilter", "*.commit").text(f"{self.path}/log")
        out, before = [], 0
        for line in sorted(r["value"] for r in logged.collect()):
            _, folder, n = line.split("|")
            out.append((folder, before, int(n)))
            before += int(n)
        return out

    def entries(self) -> DataFrame:
        found = self._commits()
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        order = self.spark.createDataFrame([(f, b) for f, b, _ in found], "batch string, before bigint")
        rows = self.spark.read.parquet(*[f"{self.path}/rows/{f}" for f, _, _ in found])
        numbered = rows.join(order, "batch").withColumn("seq", F.col("before") + F.col("at") + 1)
        return numbered.select("seq", "type", "version", "metrics", "path", "timestamp")

    def register(self, model_type: str, version: str, metrics: Mapping[str, float], path: str) -> None:
        entry = [(model_type, version, {k: float(v) for k, v in metrics.items()}, path)]
        row = self.spark.createDataFrame(entry, "type string, version string, metrics map<string,double>, path string")
        self.append(row)

    def append(self, rows: DataFrame) -> None:
        """Append entries (type, version, metrics, path); among them the order is by type and version."""
        # an entry per model version, a handful of rows
        listed = rows.agg(F.sort_array(F.collect_list(F.struct("type", "version", "path", F.map_entries("metrics").alias("m")))).alias("e"))
        batch = uuid.uuid4().hex
        listed.select(F.posexplode("e").alias("at", "r")).select(
            F.lit(batch).alias("batch"),
            F.col("at").cast("bigint").alias("at"),
            "r.type",
            "r.version",
            F.map_from_entries("r.m").alias("metrics"),
            "r.path",
            F.current_timestamp().alias("timestamp"),
        ).write.parquet(f"{self.path}/rows/{batch}")
        n = self.spark.read.parquet(f"{self.path}/rows/{batch}").count()
        while n:
            number = len(self._commits()) + 1
            if create_once(self.spark, f"{self.path}/log/{number:012d}.commit", f"{number:012d}|{batch}|{n}"):
                break

    def latest(self, model_type: str | None = None) -> DataFrame:
        """The last registered entry of a type, or of every type."""
        own = self.entries() if model_type is None else self.entries().where(F.col("type") == model_type)
        fields = ["seq", "version", "metrics", "path", "timestamp"]
        return own.groupBy("type").agg(F.max_by(F.struct(*fields), "seq").alias("e")).select("type", "e.*")
