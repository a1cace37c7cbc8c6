"""Helpers shared by the operators: tables, stored intermediate results, partition sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a result once below ``spark.checkpoint.dir`` and read it back: no second computation,
    no lineage, and every executor can reach it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often the result refers to it and wherever
    the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out, and so is a row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One label per id (the larger one if they disagree); rows without id or label are left out."""
    return (
        labels.select(F.col("doc_id").alias("label_id"), F.col(column).cast("int").alias("label"))
        .where("label_id is not null and label in (0, 1)")
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
    )


def partition_sums(
    df: DataFrame, add: Callable[[Iterator[pd.DataFrame]], dict[str, np.ndarray]], block: int = 1 << 16, together: int = 64
) -> dict[str, np.ndarray]:
    """Sum named float arrays over all partitions.

    ``add`` reduces one partition to a few arrays whose shapes do not depend on its rows. Each array
    travels in blocks, which are summed in parallel: first over ``together`` partitions each, then over
    the square of that, then over all, so that no task holds the blocks of all partitions of a large
    input. The driver receives one sum per block.
    """

    def emit(batches):
        partition = TaskContext.get().partitionId()
        for name, array in add(batches).items():
            flat = np.ascontiguousarray(array, np.float64).ravel()
            for at in range(0, len(flat), block):
                yield pd.DataFrame(
                    {
                        "run": [partition],
                        "name": [name],
                        "at": [at],
                        "shape": [list(array.shape)],
                        "part": [flat[at : at + block].tobytes()],
                    }
                )

    def total(pdf):
        acc = np.frombuffer(pdf["part"].iat[0]).copy()
        for part in pdf["part"].iloc[1:]:
            acc += np.frombuffer(part)
        return pd.DataFrame(
            {
                "run": pdf["run"].iloc[:1],
                "name": pdf["name"].iloc[:1],
                "at": pdf["at"].iloc[:1],
                "shape": pdf["shape"].iloc[:1],
                "part": [acc.tobytes()],
            }
        )

    schema = "run long, name string, at long, shape array<long>, part binary"
    parts = df.mapInPandas(emit, schema)
    for _ in range(2):
        parts = parts.withColumn("run", F.floor(F.col("run") / together))
        parts = parts.groupBy("run", "name", "at").applyInPandas(total, schema)
    rows = parts.groupBy("name", "at").applyInPandas(total, schema).collect()
    out: dict[str, np.ndarray] = {}
    for name in sorted({r["name"] for r in rows}):
        parts = sorted((r for r in rows if r["name"] == name), key=lambda r: r["at"])
        out[name] = np.concatenate([np.frombuffer(r["part"]) for r in parts]).reshape(tuple(parts[0]["shape"]))
    return out
