"""Registration of queries with a typed list of result columns.

A column list reads ``"date d, store_nbr i, sales f"``: d date, i bigint, s string,
b boolean, f double rounded to 6 digits, f2 to 2. Both sides get the same casts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPARK_TYPES = {"d": "date", "i": "bigint", "s": "string", "b": "boolean"}
SQL_TYPES = {"d": "DATE", "i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in spec.split(",")]


def _typed(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        if kind.startswith("f"):
            c = F.round(F.col(name).cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
        else:
            c = F.col(name).cast(SPARK_TYPES[kind])
        out.append(c.alias(name))
    return df.select(*out)


def _typed_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind.startswith("f"):
            out.append(f"ROUND(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS {name}")
        else:
            out.append(f"CAST({name} AS {SQL_TYPES[kind]}) AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS q"


def register(name: str, spec: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: _typed(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[name] = _typed_sql(sql, spec)
        return fn

    return add
