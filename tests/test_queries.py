"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from retailcast.models.boosted import BoostedConfig
from retailcast.queries import evaluation
from retailcast.queries import jobs as job_queries

SAMPLE = (
    "p9_series_split",
    "j4_merge_sources",
    "j11_densify",
    "a7_quartiles_global",
    "w1_lag_features",
    "w2_rolling_features",
    "w5_interpolate_global",
    "f8_oil_by_row",
    "v1_validate_series",
    "n5_interpolate_by_series",
    "y2_spectral_peaks",
    "y6_decompose",
    "b3_baselines",
    "b7_diebold_mariano",
    "m14_optimal_weights",
    "t1_naive_band",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert got == want and got


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_boosting_rounds_follow_patience(spark, sf_dir):
    """Every series runs to 50 rounds past its best one, which has the lowest validation error."""
    rows = entry.queries()["m5_boosting_rounds"](spark, sf_dir).toPandas()
    for _, part in rows.groupby(["store_nbr", "family"]):
        best = part[part["best"]]
        assert len(best) == 1 and part["round"].max() in (best["round"].iloc[0] + 50, 1000)
        assert best["valid_rmse"].iloc[0] == pytest.approx(part["valid_rmse"].min(), abs=1e-3)
