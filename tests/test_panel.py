import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import column, day, series
from retailcast.operators import joins, panel
from retailcast.operators.ordered import filled, interpolated, ordered_scan


def test_densify_carries_values_over_gaps(spark):
    df = panel.densify(series(spark, [1, 2, None, 4, 5, 6], skip=(1, 4)))
    assert column(df, "sales") == [1, 1, 1, 4, 4, 6]


def test_densify_zero_fill_over_the_whole_frame(spark):
    both = series(spark, [1, 2, 3]).union(series(spark, [9], store=2, start=day(1)))
    df = panel.densify(both, fill="zero", span="global")
    assert column(df, "sales") == [1, 2, 3, 0, 9, 0]


def test_densify_keeps_gaps_null(spark):
    assert column(panel.densify(series(spark, [1, 2, 3], skip=(1,)), fill=None), "sales") == [1, None, 3]


def test_densify_rejects_two_rows_per_day(spark):
    twice = series(spark, [1, 2]).union(series(spark, [3]))
    with pytest.raises(PySparkException, match="more than one row"):
        panel.densify(twice).collect()


def test_unknown_options_are_rejected(spark):
    with pytest.raises(ValueError):
        panel.densify(series(spark, [1]), fill="mean")
    with pytest.raises(ValueError):
        panel.densify(series(spark, [1]), span="all")


def test_daily_panel_sums_and_turns_nothing_into_zero(spark):
    twice = series(spark, [1, None]).union(series(spark, [5]))
    assert column(panel.daily_panel(twice), "sales") == [6, 0]


def test_series_split_is_positional(spark):
    df = panel.series_split(series(spark, range(11)))
    assert sum(column(df, "is_train")) == 8


def test_min_group_size_and_last_rows(spark):
    both = series(spark, range(5)).union(series(spark, range(3), store=2))
    assert {r["store_nbr"] for r in panel.min_group_size(both, min_rows=4).collect()} == {1}
    assert column(panel.last_rows(both, 2), "sales") == [3, 4, 1, 2]


def test_top_series_breaks_ties_by_name(spark):
    both = series(spark, [2, 2], family="B").union(series(spark, [4], family="A"))
    assert panel.top_series(both).collect()[0]["family"] == "A"


def test_future_calendar(spark):
    assert column(panel.future_calendar(series(spark, [1, 2]), 3), "date") == [day(2), day(3), day(4)]


def test_filters_skip_all_and_absent_columns(spark):
    df = series(spark, [1, 2, 3])
    assert panel.filter_rows(df, store_nbr="All", city="X", family=None).count() == 3
    assert panel.filter_rows(df, between=(day(1), day(2)), store_nbr=[1, 7]).count() == 2


def test_lookup_join_keeps_rows_and_rejects_duplicates(spark):
    df = series(spark, [1, 2])
    lookup = spark.createDataFrame([(1, "Quito"), (1, "Loja")], "store_nbr int, city string")
    with pytest.raises(PySparkException, match="duplicate lookup key"):
        joins.lookup_join(df, lookup, ["store_nbr"]).collect()
    assert joins.lookup_join(df, lookup, ["store_nbr"], duplicates="multiply").count() == 4
    assert joins.lookup_join(df, lookup.limit(1), ["store_nbr"]).count() == 2


def test_unused_lookup_never_multiplies_rows(spark):
    lookup = spark.createDataFrame([(1, "Quito"), (1, "Loja")], "store_nbr int, city string")
    assert len(joins.lookup_join(series(spark, [1, 2]), lookup, ["store_nbr"]).select("sales").collect()) == 2


def test_null_safe_join_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    right = spark.createDataFrame([(None, "n"), (2, "t")], "k int, w string")
    plain = {r["v"]: r["w"] for r in joins.lookup_join(left, right, ["k"]).collect()}
    safe = {r["v"]: r["w"] for r in joins.lookup_join(left, right, ["k"], null_safe=True).collect()}
    assert plain == {1: None, 2: "t"}
    assert safe == {1: "n", 2: "t"}


def test_shared_columns_get_suffixes(spark):
    left = spark.createDataFrame([(1, "a")], "k int, type string")
    right = spark.createDataFrame([(1, "b")], "k int, type string")
    row = joins.lookup_join(left, right, ["k"]).first()
    assert (row["type_x"], row["type_y"]) == ("a", "b")


def test_merge_sources_with_absent_tables(spark):
    df = series(spark, [1, 2])
    assert joins.merge_sources(df).columns == df.columns
    oil = spark.createDataFrame([(day(0), 50.0)], "date date, dcoilwtico double")
    assert column(joins.merge_sources(df, oil=oil), "dcoilwtico") == [50.0, None]


def test_global_scan_equals_one_ordered_pass(spark):
    # two dates, stores and families with nulls in many places
    values = [None, 3, None, None, 8, 1, None, None, None, 2, None, None]
    rows = [(day(i // 6), i % 6 // 2, "AB"[i % 2], v if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double")
    scanned = ordered_scan(df.repartition(3), ("date", "store_nbr", "family"), "sales")
    out = scanned.withColumns({"ff": filled("sales"), "lin": interpolated("sales")}).orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(1, 13))
    import pandas as pd

    s = pd.Series(values, dtype=float)
    assert [r["ff"] for r in out] == [None if pd.isna(v) else v for v in s.ffill()]
    expected = s.interpolate("linear").bfill().ffill()
    assert [r["lin"] for r in out] == pytest.approx(list(expected))


def test_global_scan_of_nulls_only(spark):
    df = spark.createDataFrame([(day(i), 1, "A", None) for i in range(3)], "date date, store_nbr int, family string, sales double")
    out = ordered_scan(df, ("date", "store_nbr", "family"), "sales").withColumn("lin", interpolated("sales"))
    assert column(out, "lin") == [None] * 3


def test_require_daily_grain(spark):
    ok = series(spark, [1, 2, 3])
    assert panel.require_daily_grain(ok).count() == 3
    with pytest.raises(PySparkException, match="more than one row"):
        panel.require_daily_grain(ok.union(ok)).count()


def test_hot_series_is_reduced_before_the_shuffle(spark):
    """One key with most raw rows: the partial sums carry one row per day and task."""
    raw = spark.range(20000).select(
        F.date_add(F.lit(day(0)), (F.col("id") % 5).cast("int")).alias("date"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 100).cast("int").alias("store_nbr"),
        F.lit("A").alias("family"),
        F.lit(1.0).alias("sales"),
    )
    daily = panel.daily_panel(raw)
    assert daily.agg(F.sum("sales")).first()[0] == 20000
    assert "partial_sum" in daily._jdf.queryExecution().executedPlan().toString()
