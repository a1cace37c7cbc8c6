import datetime as dt

import numpy as np
import pytest

from helpers import series
from retailcast.models import additive, sequence
from retailcast.sources.catalog import TableStore

SIMULATED = additive.AdditiveConfig(yearly_order=0, n_changepoints=10, trend_paths=2000)


def noisy(n, seed):
    rng = np.random.default_rng(seed)
    return [100 + 10 * (i % 7) + 0.5 * i + float(rng.normal(0, 4)) for i in range(n)]


def test_noise_alone_gives_the_normal_band():
    low, high = additive.simulated_bounds(np.linspace(0.01, 0.3, 20), 25, 0.0, 2.0, 3, additive.AdditiveConfig(trend_paths=20000))
    assert high == pytest.approx(np.full(20, 3.92), abs=0.2) and low == pytest.approx(np.full(20, -3.92), abs=0.2)


def test_slope_changes_widen_the_band_as_their_variance_does():
    ahead = np.array([0.1, 0.5, 1.0])
    cfg = additive.AdditiveConfig(trend_paths=20000)
    low, high = additive.simulated_bounds(ahead, 200, 0.05, 0.0, 5, cfg)
    # many small changes: normal, with the variance of the formula
    width = 1.96 * np.sqrt(2 * 0.05**2 * 200 * ahead**3 / 3)
    assert high == pytest.approx(width, rel=0.08) and low == pytest.approx(-width, rel=0.08)


def test_bounds_repeat_and_differ_by_series_and_seed():
    ahead, cfg = np.linspace(0.01, 0.3, 5), additive.AdditiveConfig(trend_paths=50)
    one = additive.simulated_bounds(ahead, 25, 0.1, 1.0, 1, cfg)
    assert np.array_equal(one, additive.simulated_bounds(ahead, 25, 0.1, 1.0, 1, cfg))
    assert not np.array_equal(one, additive.simulated_bounds(ahead, 25, 0.1, 1.0, 2, cfg))
    other = additive.AdditiveConfig(trend_paths=50, seed=7)
    assert not np.array_equal(one, additive.simulated_bounds(ahead, 25, 0.1, 1.0, 1, other))
    assert np.isfinite(additive.simulated_bounds(ahead, 0, 0.0, 1.0, 1, cfg)).all()


def test_simulated_band_covers_the_days_ahead(spark):
    both = series(spark, noisy(150, 1)).union(series(spark, noisy(150, 2), store=2, family="B")).cache()
    known = both.where(f"date < '{dt.date(2023, 1, 1) + dt.timedelta(days=120)}'")
    fitted = additive.fit_additive(known, cfg=SIMULATED).cache()
    bands = additive.predict_additive(fitted, 30, cfg=SIMULATED)
    rows = bands.collect()
    assert len(rows) == 60 and all(r["lower"] < r["yhat"] < r["upper"] for r in rows)
    hit = bands.withColumnRenamed("ds", "date").join(both, ["store_nbr", "family", "date"])
    share = hit.selectExpr("avg(if(sales between lower and upper, 1, 0)) AS s").first()["s"]
    assert share >= 0.85
    again = {(r["store_nbr"], r["ds"]): r["upper"] for r in additive.predict_additive(fitted.repartition(3), 30, cfg=SIMULATED).collect()}
    assert again == {(r["store_nbr"], r["ds"]): r["upper"] for r in rows}
    history = additive.predict_additive(fitted, 5, history=known, cfg=SIMULATED).collect()
    formula = additive.predict_additive(fitted, 5, history=known, cfg=additive.AdditiveConfig(yearly_order=0, n_changepoints=10)).collect()
    pick = lambda out: {(r["store_nbr"], r["ds"]): r["lower"] for r in out if r["ds"] < dt.date(2023, 5, 1)}
    assert pick(history) == pytest.approx(pick(formula))


def test_sequence_model_loads_without_its_configuration(spark, tmp_path):
    df = series(spark, noisy(120, 3))
    cfg = sequence.SequenceConfig(lookback=10, horizon=3, train_share=0.7)
    model = sequence.fit_sequence(df, cfg=cfg)
    path = str(tmp_path / "sequence")
    model.save(spark, path)
    again = sequence.SequenceModel.load(spark, path)
    assert again.cfg == cfg and again.keys == model.keys and again.features == ()
    rows = lambda m: sorted((r["date"], r["yhat"]) for r in m.predict(df).collect())
    assert rows(again) == rows(model)
    # a table written before models described themselves
    spark.read.parquet(path).drop("about").write.parquet(path + "-old")
    old = sequence.SequenceModel.load(spark, path + "-old", cfg)
    assert rows(old) == rows(model)


def test_a_second_root_for_a_prefix_is_refused(spark, tmp_path):
    root = str(tmp_path / "tables")
    TableStore(spark, root, "second_root_")
    TableStore(spark, root + "/", "second_root_")
    TableStore(spark, prefix="second_root_")
    with pytest.raises(ValueError, match="lie elsewhere"):
        TableStore(spark, str(tmp_path / "other"), "second_root_")
