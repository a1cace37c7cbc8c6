import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import day, series
from retailcast.models import reservoir, sequence

SMALL = reservoir.ReservoirConfig(units=24, horizon=3, washout=10)


def wave(n, phase=0.0):
    return [100 + 20 * np.sin(2 * np.pi * i / 7 + phase) + 0.1 * i for i in range(n)]


@pytest.fixture(scope="module")
def two(spark):
    return series(spark, wave(120)).union(series(spark, wave(90, 1.0), store=2, family="B")).cache()


def plain_states(values, cfg):
    into, weights = reservoir.layer(cfg, 1)
    state, out = [0.0] * cfg.units, []
    for v in values:
        state = [
            (1 - cfg.leak) * state[j]
            + cfg.leak * np.tanh(into[j][0] + into[j][1] * v + sum(weights[j][k] * state[k] for k in range(cfg.units)))
            for j in range(cfg.units)
        ]
        out.append(state)
    return np.array(out)


def test_layer_is_fixed_sparse_and_of_the_radius_asked_for():
    into, weights = reservoir.layer(SMALL, 2)
    assert into.shape == (24, 3) and (np.abs(into) <= 1).all()
    assert ((weights != 0).sum(axis=1) <= SMALL.links).all()
    assert np.abs(np.linalg.eigvals(weights)).max() == pytest.approx(0.9)
    other, _ = reservoir.layer(reservoir.ReservoirConfig(units=24, horizon=3, washout=10, seed=1), 2)
    assert not np.allclose(into, other)
    drawn = reservoir.hash_uniform(20000, 7, 42)
    assert abs(drawn.mean()) < 0.02 and drawn.std() == pytest.approx(3**-0.5, abs=0.01)


def test_states_equal_a_plain_loop_and_go_on_from_a_stored_state():
    values = np.array([0.1, 0.9, 0.3, 0.7, 0.2, 0.0])
    states = reservoir.advance(values[:, None], SMALL)
    assert states == pytest.approx(plain_states(values, SMALL), abs=1e-12)
    resumed = reservoir.advance(values[4:, None], SMALL, states[3])
    assert resumed == pytest.approx(states[4:], abs=1e-15)
    assert reservoir.advance(np.empty((0, 1)), SMALL).shape == (0, 24)


def test_windows_hold_the_states_of_the_series_and_are_those_of_the_linear_map(two):
    out = reservoir.reservoir_windows(two, cfg=SMALL)
    rows = {(r["store_nbr"], r["date"]): r for r in out.collect()}
    scaling = sequence.SequenceConfig()
    panel = sequence._scaled_panel(two, scaling, ("store_nbr", "family"), "date", "sales", ()).collect()
    mine = sorted((r["date"], r["_s0"]) for r in panel if r["store_nbr"] == 2)
    states = plain_states([v for _, v in mine], SMALL)
    at = 40
    row = rows[(2, mine[at][0])]
    assert row["x"] == pytest.approx(states[at], abs=1e-12)
    assert row["y"] == pytest.approx([v for _, v in mine[at + 1 : at + 4]])
    linear = sequence.supervised_windows(
        sequence._scaled_panel(two, scaling, ("store_nbr", "family"), "date", "sales", ()),
        SMALL.washout, SMALL.horizon, columns=["_s0"], part="is_train",
    )
    assert {(r["store_nbr"], r["date"]) for r in linear.collect()} == set(rows)


def test_forecast_follows_the_wave_and_survives_storage(spark, two, tmp_path):
    model = reservoir.fit_reservoir(two, cfg=SMALL)
    out = model.predict(two).orderBy("store_nbr", "date").collect()
    assert [r["date"] for r in out] == [day(120 + i) for i in range(3)] + [day(90 + i) for i in range(3)]
    assert [r["yhat"] for r in out[:3]] == pytest.approx(wave(123)[120:], abs=4)
    best = [e for e in model.history if e[4]]
    assert len(best) == 1 and best[0][3] == min(e[3] for e in model.history)
    assert model.losses(spark).count() == len(model.history)
    path = str(tmp_path / "reservoir")
    model.save(spark, path)
    again = reservoir.ReservoirModel.load(spark, path)
    assert again.cfg == SMALL and again.keys == ("store_nbr", "family")
    assert [r["yhat"] for r in again.predict(two).orderBy("store_nbr", "date").collect()] == [r["yhat"] for r in out]


def test_a_nonlinear_series_is_beyond_the_linear_map(spark):
    values = [0.3]
    for _ in range(599):
        values.append(3.8 * values[-1] * (1 - values[-1]))
    df = series(spark, values)
    cfg = reservoir.ReservoirConfig(horizon=1, washout=28)
    recurrent = min(e[3] for e in reservoir.fit_reservoir(df, cfg=cfg).history)
    linear = min(e[3] for e in sequence.fit_sequence(df, cfg=sequence.SequenceConfig(horizon=1)).history)
    assert recurrent < 0.2 * linear


def test_one_series_without_keys_features_nulls_and_no_data(spark, two):
    total = two.where("store_nbr = 1").select("date", "sales")
    assert reservoir.fit_reservoir(total, keys=(), cfg=SMALL).predict(total).count() == 3
    cfg = SMALL
    wide = two.withColumn("promo", F.weekday("date").cast("double")).withColumn(
        "sales", F.when(F.col("date") != F.lit(dt.date(2023, 1, 20)), F.col("sales"))
    )
    model = reservoir.fit_reservoir(wide, features=("promo",), cfg=cfg)
    assert model.beta.shape == (25, 3) and model.predict(wide).where("yhat is null").count() == 0
    assert reservoir.fit_reservoir(two.limit(0), cfg=cfg) is None
    assert reservoir.fit_reservoir(series(spark, wave(8)), cfg=cfg) is None
    short = two.unionByName(series(spark, wave(5), store=3, family="C"))
    assert model.features == ("promo",)
    assert reservoir.fit_reservoir(two, cfg=cfg).predict(short).where("store_nbr = 3").count() == 0


def test_a_second_row_of_a_day_is_refused(two):
    with pytest.raises(Exception, match="more than one row of a series"):
        reservoir.fit_reservoir(two.union(two.where("store_nbr = 2")), cfg=SMALL)
