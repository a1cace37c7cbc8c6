"""Boosted trees: splits against an exhaustive search, patience, stored models, future days."""

import numpy as np
import pytest
from helpers import series
from pyspark.sql import functions as F

from retailcast.models import boosted
from retailcast.models import series_boosted as sb
from retailcast.models.boosted import BoostedConfig
from retailcast.operators import features

WHOLE = BoostedConfig(n_estimators=30, max_depth=3, subsample=1.0, colsample=1.0, patience=None)


def brute_split(x, g, h, rows, cfg):
    """The best (gain, feature, value) over all features and all values of some rows."""

    def worth(mask):
        kept = max(abs(g[mask].sum()) - cfg.reg_alpha, 0)
        return kept**2 / (h[mask].sum() + cfg.reg_lambda)

    best = (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        for v in np.unique(x[rows, f])[:-1]:
            left, right = rows & (x[:, f] <= v), rows & (x[:, f] > v)
            if min(h[left].sum(), h[right].sum()) >= cfg.min_child_rows:
                gain = worth(left) + worth(right) - worth(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, f, v)
    return best


@pytest.mark.parametrize("alpha, reg, child", [(0.0, 1.0, 1), (2.0, 0.5, 3), (0.0, 0.0, 5)])
def test_tree_equals_exhaustive_search(alpha, reg, child):
    rng = np.random.default_rng(int(10 * (alpha + reg)))
    x = rng.integers(0, 12, (80, 4)).astype(float)
    g, h = rng.standard_normal(80) * 5, np.ones(80)
    cfg = BoostedConfig(max_depth=3, reg_alpha=alpha, reg_lambda=reg, min_child_rows=child, learning_rate=0.3)
    cuts = [sb.cut_points(x[:, f], 64) for f in range(4)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    tree = sb.grow(binned, cuts, g, h, np.ones(4, bool), cfg)
    members = {0: np.ones(80, bool)}
    for node in range(7):
        if node not in members:
            continue
        rows = members[node]
        gain, f, _ = brute_split(x, g, h, rows, cfg)
        assert tree.feature[node] == f
        if f >= 0:
            left = rows & (x[:, f] <= tree.threshold[node])
            members[2 * node + 1], members[2 * node + 2] = left, rows & ~left
            _, _, v = brute_split(x, g, h, rows, cfg)
            assert (x[rows, f] <= v).tolist() == left[rows].tolist()
    leaf = tree.leaves(x)
    for node in np.unique(leaf):
        rows = leaf == node
        total = np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - alpha, 0)
        assert tree.value[node] == pytest.approx(-0.3 * total / (rows.sum() + reg))


def test_cut_points_of_ties_and_many_values():
    assert sb.cut_points(np.array([1.0, 1, 1]), 4).tolist() == []
    assert sb.cut_points(np.array([3.0, 1, 2, 2]), 4).tolist() == [1, 2]
    many = sb.cut_points(np.concatenate([np.zeros(500), np.arange(500.0)]), 16)
    assert 0 in many and 6 <= len(many) <= 16 and many.max() < 499


def test_patience_returns_to_the_best_round():
    rng = np.random.default_rng(1)
    x, xv = rng.random((120, 3)), rng.random((60, 3))
    y, yv = x[:, 0] + rng.standard_normal(120), xv[:, 0] + rng.standard_normal(60)
    cfg = BoostedConfig(n_estimators=400, max_depth=4, patience=15)
    base, trees, history = sb.boost(x, y, xv, yv, cfg)
    errors = [h[1] for h in history]
    assert len(history) == len(trees) + 15 < 400 and np.argmin(errors) + 1 == len(trees)
    assert sb.rmse(base + sum(t.predict(xv) for t in trees) - yv) == pytest.approx(min(errors))
    _, every, history = sb.boost(x, y, xv, yv, BoostedConfig(n_estimators=40, max_depth=4, patience=None))
    assert len(every) == len(history) == 40 and np.diff([h[0] for h in history]).max() < 0.05
    assert boosted.best_round(errors, 15) == (len(trees), True) and boosted.best_round(errors[:3], 15)[1] is False
    assert boosted.best_round([3, 2, 2, 2.5], None) == (4, True) and boosted.best_round([3, 2, 2, 2.5], 9)[0] == 2


def test_samples_are_drawn_by_hash():
    a = sb.drawn(np.arange(20_000), 7, 0.8)
    assert abs(a.mean() - 0.8) < 0.02 and (a == sb.drawn(np.arange(20_000), 7, 0.8)).all() and (a != sb.drawn(np.arange(20_000), 8, 0.8)).any()
    assert sb.drawn(np.arange(50), 3, 1.0).all()


def wave(n):
    return [50 + 20 * np.sin(i / 7 * 2 * np.pi) + i / 10 for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    panel = series(spark, wave(260)).union(series(spark, [2 * v for v in wave(260)], store=2)).union(series(spark, [1] * 30, store=3)).cache()
    frame = features.engineer_all_features(panel, lags=(7, 14), windows=(7,)).cache()
    return panel, frame, sb.fit_series_boosters(frame, cfg=WHOLE)


def test_series_models(fitted, tmp_path):
    panel, frame, model = fitted
    out = model.predict(frame)
    assert out.columns == ["date", "store_nbr", "family", "prediction"] and out.count() == 520
    error = out.join(frame, ["date", "store_nbr", "family"]).agg(F.avg(F.abs(F.col("prediction") - F.col("sales")))).first()[0]
    assert error < 6
    rounds = model.rounds().collect()
    assert len(rounds) == 60 and sum(r["best"] for r in rounds) == 2
    shares = model.top_features(100).collect()
    assert sum(r["importance"] for r in shares) == pytest.approx(1)
    model.save(str(tmp_path / "m"))
    again = sb.SeriesBoosters.load(str(tmp_path / "m"))
    assert sorted(map(tuple, again.predict(frame).collect())) == sorted(map(tuple, out.collect()))


def test_future_days_equal_a_plain_loop(spark, fitted):
    panel, frame, model = fitted
    got = {(r["store_nbr"], r["date"]): r["yhat"] for r in model.roll_forward(panel, 10, lags=(7, 14), windows=(7,)).collect()}
    assert len(got) == 20
    grown = panel
    for step in range(1, 4):  # append a day, predict it directly, go on from the prediction
        days = sb.future_calendar(panel, step)
        last = days.join(days.groupBy("store_nbr").agg(F.max("date").alias("date")), ["store_nbr", "date"], "left_semi")
        grown = grown.unionByName(last, allowMissingColumns=True)
        direct = model.predict(features.engineer_all_features(grown, lags=(7, 14), windows=(7,)))
        ahead = direct.join(last.select("store_nbr", "date"), ["store_nbr", "date"]).collect()
        for r in ahead:
            assert got[r["store_nbr"], r["date"]] == pytest.approx(r["prediction"], abs=1e-9)
        filled = spark.createDataFrame([(r["store_nbr"], r["date"], r["prediction"]) for r in ahead], "store_nbr int, date date, p double")
        grown = grown.join(filled, ["store_nbr", "date"], "left").withColumn("sales", F.coalesce("sales", "p")).drop("p")
    flat = [v for (s, _), v in got.items() if s == 1]
    assert max(flat) - min(flat) > 15  # the wave goes on


def test_no_series_is_long_enough(spark):
    frame = features.engineer_all_features(series(spark, range(40)), lags=(7,), windows=(7,))
    model = sb.fit_series_boosters(frame)
    assert model.predict(frame).count() == 0 and model.rounds().count() == 0 and model.top_features().count() == 0
    assert model.roll_forward(series(spark, range(40)), 5).count() == 0


def test_pooled_boosting_keeps_more_than_one_tree(spark, fitted):
    _, frame, _ = fitted
    cfg = BoostedConfig(n_estimators=24, max_depth=3, patience=6, subsample=1.0, colsample=1.0)
    model = boosted.fit_boosted(frame, cfg=cfg)
    kept = model.pipeline.stages[-1].getNumTrees
    assert model.predict(frame).count() == 520
    assert kept == boosted.best_round(model.errors, 6)[0] and 5 < kept <= len(model.errors) <= 24
    assert min(model.errors) < 0.8 * model.errors[0]
    every = boosted.fit_boosted(frame, cfg=BoostedConfig(n_estimators=4, max_depth=2, patience=None))
    assert every.pipeline.stages[-1].getNumTrees == 4 and len(every.errors) == 4
    short = boosted.first_trees(model.pipeline.stages[-1], 2)
    assert short.getNumTrees == 2 and short.getFeaturesCol() == "_features"
