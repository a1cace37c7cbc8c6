import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import column, day, series
from retailcast.operators import anomaly, forest, quality
from retailcast.operators.quantiles import global_quantiles


def test_clean_table_is_valid(spark):
    row = quality.validate_sales_data(series(spark, range(30))).first()
    assert row["is_valid"] and row["missing_dates"] == [] and row["warnings"] == []


def test_gaps_negatives_and_nulls(spark):
    df = series(spark, [1, -5, None, 4, -3], skip=(3,))
    row = quality.validate_sales_data(df).first()
    assert not row["is_valid"]
    assert row["missing_dates"] == [str(day(3))]
    assert row["negative_sales_count"] == 2
    assert row["missing_values_count"] == {"date": 0, "store_nbr": 0, "family": 0, "sales": 1}
    assert len(row["warnings"]) == 3


def test_nulls_do_not_invalidate(spark):
    assert quality.validate_sales_data(series(spark, [1, None, 3])).first()["is_valid"]


def test_empty_table(spark):
    row = quality.validate_sales_data(series(spark, [])).first()
    assert row["is_valid"] and row["missing_values_count"]["sales"] == 0


def test_gaps_per_series(spark):
    both = series(spark, [1, 2, 3], skip=(1,)).union(series(spark, [1, 2, 3], store=2))
    assert quality.validate_sales_data(both).first()["is_valid"]
    rows = quality.validate_sales_data(both, keys=("store_nbr", "family")).collect()
    assert {r["store_nbr"]: r["is_valid"] for r in rows} == {1: False, 2: True}


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [5.0] * 50, list(np.random.default_rng(0).lognormal(0, 3, 2000))])
def test_global_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    probs = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = global_quantiles(df, "x", probs, buckets=16).first()["q"]
    assert got == pytest.approx(np.quantile(values, probs), rel=1e-12)


def test_global_quantiles_skip_nan_and_hot_values(spark):
    # a third of the rows is one value
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    df = df.union(spark.createDataFrame([(float("nan"),), (None,)], "x double"))
    values = [7.0 if i % 3 == 0 else float(i) for i in range(3000)]
    assert global_quantiles(df, "x", (0.25, 0.75), 64).first()["q"] == pytest.approx(np.quantile(values, [0.25, 0.75]))


def test_global_quantiles_of_nothing(spark):
    assert global_quantiles(spark.createDataFrame([], "x double"), "x", (0.5,)).first()["q"] == [None]


MICRO = [10, 11, 12, 13, 14, 15, 100]


@pytest.mark.parametrize("keys", [None, ("store_nbr", "family")])
def test_iqr_flags_the_outlier(spark, keys):
    assert column(anomaly.detect_iqr(series(spark, MICRO), keys=keys), "anomaly_iqr") == [False] * 6 + [True]
    assert not any(column(anomaly.detect_iqr(series(spark, [10, 11, 12, 13, 14]), keys=keys), "anomaly_iqr"))


def test_iqr_never_flags_null(spark):
    assert column(anomaly.detect_iqr(series(spark, [*MICRO, None])), "anomaly_iqr")[-1] is False


def test_per_series_fences_differ(spark):
    both = series(spark, MICRO).union(series(spark, [100] * 7, store=2))
    flags = column(anomaly.detect_iqr(both, keys=("store_nbr", "family")), "anomaly_iqr")
    assert flags == [False] * 6 + [True] + [False] * 7


@pytest.fixture(scope="module")
def detected(spark):
    return anomaly.detect_anomalies(series(spark, [10, 11, 100, 13, 14, 15, 12])).cache()


def test_detect_without_features_has_no_forest(detected):
    assert not any(column(detected, "anomaly_if"))
    assert column(detected, "is_anomaly").count(True) == 1


def test_interpolation(detected):
    for keys in (None, ("store_nbr", "family")):
        out = anomaly.handle_anomalies(detected, "interpolate", keys=keys)
        assert column(out, "sales") == [10, 11, 12, 13, 14, 15, 12]
        assert out.columns == detected.columns


def test_interpolation_at_the_ends_and_of_earlier_nulls(spark):
    df = anomaly.detect_anomalies(series(spark, [100, 10, None, 12, 11, 10, 12, 11, 900]), keys=("store_nbr", "family"))
    out = anomaly.handle_anomalies(df, "interpolate", keys=("store_nbr", "family"))
    assert column(out, "sales") == [10, 10, 11, 12, 11, 10, 12, 11, 11]


def test_cap_uses_its_own_multiplier_on_all_rows(spark):
    df = anomaly.detect_anomalies(series(spark, MICRO), multiplier=100.0)
    assert not any(column(df, "is_anomaly"))
    q1, q3 = np.quantile(MICRO, [0.25, 0.75])
    assert column(anomaly.handle_anomalies(df, "cap"), "sales")[-1] == pytest.approx(q3 + 1.5 * (q3 - q1))


def test_remove_and_records(detected):
    assert anomaly.handle_anomalies(detected, "remove").count() == 6
    record = anomaly.anomaly_records(detected, "remove").first()
    assert (record["original_value"], record["new_value"], record["method"], record["action"]) == (100, None, "iqr", "remove")
    assert anomaly.anomaly_records(detected, "interpolate").first()["new_value"] == 12


def test_unknown_strategy(detected):
    with pytest.raises(ValueError):
        anomaly.handle_anomalies(detected, "ignore")


def test_report_of_nothing_has_a_header(spark, tmp_path):
    from retailcast.sources import files

    clean = anomaly.detect_anomalies(series(spark, [1, 2, 3]))
    files.write_csv(anomaly.anomaly_records(clean, "cap"), str(tmp_path / "r.csv"))
    back = files.load_anomaly_report(spark, str(tmp_path / "r.csv"))
    assert back.count() == 0 and "new_value" in back.columns


def forest_frame(spark):
    rng = np.random.default_rng(42)
    points = np.vstack([rng.normal(size=(400, 2)), [[10, 10], [11, 11], [-10, -10]]])
    rows = [(day(i), 1, "A", float(a), float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "date date, store_nbr int, family string, f1 double, f2 double")


def test_forest_finds_the_far_points(spark):
    df = forest_frame(spark)
    forest = anomaly.IsolationForest(contamination=0.01).fit(df, ("f1", "f2"), ("date", "store_nbr", "family"))
    flagged = forest.flag(df).where("anomaly_if").collect()
    assert {(r["f1"], r["f2"]) for r in flagged} >= {(10.0, 10.0), (11.0, 11.0), (-10.0, -10.0)}
    assert 3 <= len(flagged) <= 5
    assert len(forest.trees) == 100


def test_forest_does_not_depend_on_partitions(spark):
    df = forest_frame(spark)
    key = ("date", "store_nbr", "family")
    flags = []
    for parts in (1, 7):
        own = df.repartition(parts)
        out = anomaly.IsolationForest(n_trees=20).fit(own, ("f1", "f2"), key).flag(own)
        flags.append(column(out, "anomaly_if"))
    assert flags[0] == flags[1]


def test_forest_fills_nulls_with_the_median(spark):
    df = forest_frame(spark).withColumn("f1", F.when(F.col("date") != F.lit(day(0)), F.col("f1")))
    forest = anomaly.IsolationForest(n_trees=5).fit(df, ("f1", "f2"), ("date",))
    known = [r["f1"] for r in df.collect() if r["f1"] is not None]
    assert forest.medians[0] == pytest.approx(np.median(known))
    assert forest.flag(df).where("anomaly_if is null").count() == 0


def test_both_detectors(spark):
    df = forest_frame(spark).withColumn("sales", F.lit(1.0))
    out = anomaly.detect_anomalies(df, multivariate_features=("f1", "f2"))
    assert out.where("is_anomaly").count() == out.where("anomaly_if").count() > 0
    assert {r["method"] for r in anomaly.anomaly_records(out, "remove").collect()} == {"isolation_forest"}


def test_forest_as_a_table_gives_the_scores(spark):
    df = forest_frame(spark)
    grown = anomaly.IsolationForest(n_trees=7, sample_size=32).fit(df, ("f1", "f2"), ("date", "store_nbr", "family"))
    table = {(r["tree"], r["node"]): r for r in grown.tree_table(spark).collect()}
    unit = float(forest.mean_path(grown.drawn))
    for row in df.withColumn("_score", grown.score()).collect():
        total = 0.0
        for tree in range(7):
            node = 1
            while table[tree, node]["depth"] is None:
                cut = table[tree, node]
                node = 2 * node + (row[cut["feature"]] > cut["threshold"])
            total += table[tree, node]["depth"]
        assert row["_score"] == pytest.approx(2 ** (-total / (7 * unit)), abs=1e-11)


def test_trees_come_from_hashes_and_split_every_node():
    points = np.array([[float(i), float(i % 3)] for i in range(20)] + [[1.0, 1.0]] * 5)
    grown = forest._grow(points, 4, 42, 3)
    assert grown == forest._grow(points[::-1], 4, 42, 3)
    assert grown != forest._grow(points, 4, 43, 3)
    assert len(set(grown["number"])) == len(grown["number"]) and max(grown["number"]) < 2**5
    which, where = zip(*[forest.node_draws(1, 2, k) for k in range(4000)], strict=True)
    assert np.mean(which) == pytest.approx(0.5, abs=0.02) and np.mean(where) == pytest.approx(0.5, abs=0.02)
    assert abs(np.corrcoef(which, where)[0, 1]) < 0.05
    same = forest._grow(np.ones((6, 2)), 4, 42, 0)  # nothing to cut
    assert same["feature"] == [-1] and same["depth"] == [pytest.approx(float(forest.mean_path(6)))]


def test_forest_takes_null_keys_and_one_row(spark):
    rows = [(None, 1.0, 2.0), ("a", 3.0, None)]
    df = spark.createDataFrame(rows, "k string, f1 double, f2 double")
    grown = anomaly.IsolationForest(n_trees=3).fit(df, ("f1", "f2"), ("k",))
    assert grown.flag(df).count() == 2
    one = df.limit(1)
    assert anomaly.IsolationForest(n_trees=3).fit(one, ("f1",), ("k",)).flag(one).where("anomaly_if").count() == 0
