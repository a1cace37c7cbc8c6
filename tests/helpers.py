from __future__ import annotations

import datetime as dt

DAY0 = dt.date(2023, 1, 1)
SALES_SCHEMA = "date date, store_nbr int, family string, sales double"


def day(i, start=DAY0):
    return start + dt.timedelta(days=i)


def series(spark, values, store=1, family="A", start=DAY0, skip=()):
    """One series of daily values; ``skip`` leaves days out."""
    rows = [(day(i, start), store, family, None if v is None else float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, SALES_SCHEMA)


def column(df, name, order=("store_nbr", "family", "date")):
    keys = [c for c in order if c in df.columns]
    return [r[name] for r in df.orderBy(*keys).collect()]
