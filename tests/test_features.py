import datetime as dt
import math

import pytest

from helpers import column, day, series
from retailcast.operators import features


def test_lags_are_positions_in_the_series(spark):
    df = features.add_lag_features(series(spark, range(10)), lags=(1, 7))
    assert column(df, "sales_lag_7") == [None] * 7 + [0, 1, 2]
    assert column(df, "sales_lag_1")[1] == 0


def test_rolling_leaves_the_current_row_out(spark):
    out = features.add_rolling_features(series(spark, [1, 2, 3, 4]), windows=(2,))
    assert column(out, "sales_rolling_mean_2") == [None, 1, 1.5, 2.5]
    assert column(out, "sales_rolling_std_2")[:2] == [None, None]
    assert column(out, "sales_rolling_std_2")[2] == pytest.approx(math.sqrt(0.5))
    assert column(out, "sales_rolling_min_2") == [None, 1, 1, 2]
    assert column(out, "sales_rolling_max_2") == [None, 1, 2, 3]


def test_series_do_not_mix(spark):
    both = series(spark, [1, 2]).union(series(spark, [10, 20], store=2))
    assert column(features.add_lag_features(both, lags=(1,)), "sales_lag_1") == [None, 1, None, 10]


def test_rows_with_a_null_key_get_no_features(spark):
    rows = [(day(0), None, "A", 1.0), (day(1), None, "A", 2.0)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double")
    assert column(features.add_lag_features(df, lags=(1,)), "sales_lag_1") == [None, None]


def test_calendar(spark):
    monday, saturday = dt.date(2023, 1, 2), dt.date(2023, 12, 30)
    df = spark.createDataFrame([(monday,), (saturday,), (dt.date(2024, 2, 29),)], "date date")
    first, second, third = features.add_temporal_features(df).orderBy("date").collect()
    assert (first["day_of_week"], first["is_weekend"], first["week_of_year"]) == (0, 0, 1)
    assert (second["day_of_week"], second["is_weekend"], second["quarter"]) == (5, 1, 4)
    assert (third["is_month_end"], third["is_month_start"], third["day_of_month"]) == (1, 0, 29)


def test_dates_given_as_text(spark):
    df = spark.createDataFrame([("2023-01-02 00:00:00",), ("nonsense",)], "date string")
    assert {r["day_of_week"] for r in features.add_temporal_features(df).collect()} == {0, None}


def test_holidays_and_payday(spark):
    df = series(spark, [1] * 31)
    holidays = spark.createDataFrame(
        [(day(0), "Holiday"), (day(1), "Additional Day"), (day(0), "Holiday")], "date date, type string"
    )
    out = features.add_holiday_features(df, holidays=holidays)
    assert column(out, "is_holiday_holiday")[:3] == [1, 0, 0]
    assert column(out, "is_holiday_additional_day")[:3] == [0, 1, 0]
    pay = column(out, "days_to_payday")
    assert (pay[0], pay[14], pay[30], pay[22]) == (14, 0, 0, 8)


def test_payday_without_holidays(spark):
    assert features.add_holiday_features(series(spark, [1])).columns[-1] == "days_to_payday"


def test_promotion(spark):
    df = spark.createDataFrame([(None,), (2.7,)], "onpromotion double")
    assert sorted(r[0] for r in features.add_promotion_features(df).collect()) == [0, 2]
    assert features.add_promotion_features(series(spark, [1])).columns == ["date", "store_nbr", "family", "sales"]


OIL = [70.0, None, 72.0, 73.0, 74.0, 75.0, 76.0, 77.0]


def oil_frame(spark, families=("A",)):
    rows = [(day(i), 1, f, 1.0, p) for i, p in enumerate(OIL) for f in families]
    return spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, dcoilwtico double")


def test_oil_by_date(spark):
    out = features.add_oil_features(oil_frame(spark))
    assert column(out, "oil_price")[:3] == [70, 70, 72]
    assert column(out, "oil_price_lag_7") == [None] * 7 + [70]
    assert column(out, "oil_price_change")[7] == pytest.approx(0.1)


def test_oil_by_row_steps_over_rows(spark):
    one = features.add_oil_features(oil_frame(spark), by="row")
    assert column(one, "oil_price_lag_7") == [None] * 7 + [70]
    two = features.add_oil_features(oil_frame(spark, ("A", "B")), by="row").orderBy("date", "family").collect()
    assert [r["oil_price_lag_7"] for r in two][7:9] == [70, 70]


def test_oil_zero_price_gives_null_change(spark):
    rows = [(day(i), 1, "A", float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, dcoilwtico double")
    assert column(features.add_oil_features(df), "oil_price_change")[7] is None


def test_all_features_keep_the_rows(spark):
    df = oil_frame(spark, ("A", "B"))
    holidays = spark.createDataFrame([(day(0), "Holiday")], "date date, type string")
    out = features.engineer_all_features(df, holidays, lags=(7,), windows=(7,))
    assert out.count() == df.count()
    assert {"sales_lag_7", "sales_rolling_std_7", "is_holiday_holiday", "oil_price_change", "week_of_year"} <= set(out.columns)


def test_all_features_shuffle_the_series_once(spark):
    df = oil_frame(spark, ("A", "B"))
    plan = features.engineer_all_features(df, lags=(7,), windows=(7,))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(store_nbr") == 1


def test_feature_columns_and_finite_values(spark):
    rows = [(1, 2.0, "x", float("nan"), float("inf"))]
    df = spark.createDataFrame(rows, "id int, sales double, family string, b double, a double")
    assert features.feature_columns(df) == ["a", "b"]
    row = df.select(features.finite("a").alias("a"), features.finite("b").alias("b")).first()
    assert (row["a"], row["b"]) == (features.MAX_DOUBLE, 0.0)


def test_scaling_round_trip(spark):
    from pyspark.sql import functions as F

    df = features.min_max_scale(series(spark, [10, 20, 30]))
    back = df.withColumn("back", features.unscaled(F.col("sales_scaled"), F.lit(10.0), F.lit(30.0)))
    assert column(df, "sales_scaled") == pytest.approx([0, 0.5, 1])
    assert column(back, "back") == pytest.approx([10, 20, 30])


def test_constant_series_scales_to_zero(spark):
    assert column(features.min_max_scale(series(spark, [5, 5])), "sales_scaled") == [0, 0]
