"""Filters, joins, aggregates, windows, sorting and set operations on the panel."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from retailcast.models.boosted import BoostedModel
from retailcast.operators import features, joins, panel, quality, quantiles
from retailcast.operators.anomaly import interpolate_nulls
from retailcast.operators.ordered import global_lag, ordered_scan
from retailcast.plans import bindings as b
from retailcast.queries.registry import register
from retailcast.queries.tables import DENSE, HOLIDAY_ROWS, LINES, OIL, SALES, STORES, TRANSACTIONS

P = "(PARTITION BY store_nbr, family ORDER BY date)"


# ---- projection and filters


@register("p1_rename_columns", "ds d, y f", f"WITH {SALES} SELECT date AS ds, sales AS y FROM sales")
def rename_columns(spark, sf):
    return b.sales(spark, sf).select("date", "sales").withColumnsRenamed({"date": "ds", "sales": "y"})


@register(
    "p2_filter_in_list",
    "date d, store_nbr i, family s, sales f",
    f"WITH {SALES} SELECT * FROM sales WHERE store_nbr IN (1, 2, 3)",
)
def filter_in_list(spark, sf):
    return panel.filter_rows(b.sales(spark, sf), store_nbr=[1, 2, 3])


@register(
    "p3_filter_series_and_range",
    "date d, store_nbr i, family s, sales f",
    f"WITH {SALES} SELECT * FROM sales WHERE store_nbr = 1 AND family = 'ECONOMY' "
    "AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def filter_series_and_range(spark, sf):
    span = ("1996-01-01", "1999-12-31")
    return panel.filter_rows(b.sales(spark, sf), between=span, store_nbr=1, family="ECONOMY")


@register(
    "p4_optional_filters",
    "date d, store_nbr i, family s, sales f",
    f"WITH {SALES} SELECT * FROM sales WHERE family = 'ECONOMY'",
)
def optional_filters(spark, sf):
    return panel.filter_rows(b.sales(spark, sf), store_nbr="All", family="ECONOMY", method="iqr")


_WITH_OIL = f"{SALES}, {OIL}, m AS (SELECT s.*, o.dcoilwtico FROM sales s LEFT JOIN oil o ON s.date = o.date)"


@register(
    "p5_drop_null_rows",
    "date d, store_nbr i, family s, sales f, dcoilwtico f",
    f"WITH {_WITH_OIL} SELECT * FROM m WHERE dcoilwtico IS NOT NULL",
)
def drop_null_rows(spark, sf):
    return joins.merge_sources(b.sales(spark, sf), oil=b.oil(spark, sf)).dropna()


@register(
    "p7_feature_columns",
    "name s, n_known i",
    f"""WITH {SALES}, f AS (
      SELECT *, LAG(sales, 7) OVER {P} AS sales_lag_7, LAG(sales, 28) OVER {P} AS sales_lag_28 FROM sales)
    SELECT 'onpromotion' AS name, COUNT(onpromotion) AS n_known FROM f
    UNION ALL SELECT 'sales_lag_28', COUNT(sales_lag_28) FROM f
    UNION ALL SELECT 'sales_lag_7', COUNT(sales_lag_7) FROM f""",
)
def feature_columns(spark, sf):
    df = features.add_lag_features(b.sales(spark, sf), lags=(7, 28))
    names = features.feature_columns(df)
    known = df.agg(*[F.count(n).alias(n) for n in names])
    return known.unpivot([], names, "name", "n_known")


@register(
    "p8_finite_features",
    "date d, store_nbr i, family s, sales_lag_7 f, dcoilwtico f",
    f"""WITH {_WITH_OIL} SELECT date, store_nbr, family,
      COALESCE(LAG(sales, 7) OVER {P}, 0) AS sales_lag_7, COALESCE(dcoilwtico, 0) AS dcoilwtico FROM m""",
)
def finite_features(spark, sf):
    merged = joins.merge_sources(b.sales(spark, sf), oil=b.oil(spark, sf))
    df = features.add_lag_features(merged, lags=(7,))
    return df.withColumns({c: features.finite(c) for c in ("sales_lag_7", "dcoilwtico")})


@register(
    "p9_series_split",
    "date d, store_nbr i, family s, is_train b",
    f"""WITH {SALES} SELECT date, store_nbr, family,
      ROW_NUMBER() OVER {P} <= FLOOR(COUNT(*) OVER (PARTITION BY store_nbr, family) * 0.8) AS is_train FROM sales""",
)
def series_split(spark, sf):
    return panel.series_split(b.sales(spark, sf))


@register(
    "p10_min_group_size",
    "store_nbr i, family s, n i",
    f"WITH {SALES} SELECT store_nbr, family, COUNT(*) AS n FROM sales GROUP BY 1, 2 HAVING COUNT(*) >= 1300",
)
def min_group_size(spark, sf):
    kept = panel.min_group_size(b.sales(spark, sf), min_rows=1300)
    return kept.groupBy("store_nbr", "family").agg(F.count(F.lit(1)).alias("n"))


# ---- joins


@register(
    "j1_join_stores",
    "date d, store_nbr i, family s, sales f, city s",
    f"WITH {SALES}, {STORES} SELECT s.*, city FROM sales s LEFT JOIN stores t ON s.store_nbr = t.store_nbr",
)
def join_stores(spark, sf):
    return joins.lookup_join(b.sales(spark, sf), b.stores(spark, sf), ["store_nbr"])


@register("j2_join_oil", "date d, store_nbr i, family s, sales f, dcoilwtico f", f"WITH {_WITH_OIL} SELECT * FROM m")
def join_oil(spark, sf):
    return joins.lookup_join(b.sales(spark, sf), b.oil(spark, sf), ["date"])


@register(
    "j3_join_transactions",
    "date d, store_nbr i, family s, sales f, transactions i",
    f"""WITH {SALES}, {TRANSACTIONS} SELECT s.*, transactions FROM sales s
      LEFT JOIN transactions t ON s.date = t.date AND s.store_nbr = t.store_nbr""",
)
def join_transactions(spark, sf):
    return joins.lookup_join(b.sales(spark, sf), b.transactions(spark, sf), ["date", "store_nbr"], null_safe=True)


_MERGED = f"""{SALES}, {STORES}, {OIL}, {TRANSACTIONS}, merged AS (
  SELECT s.*, city, dcoilwtico, transactions FROM sales s
  LEFT JOIN stores t ON s.store_nbr = t.store_nbr LEFT JOIN oil o ON s.date = o.date
  LEFT JOIN transactions x ON s.date = x.date AND s.store_nbr = x.store_nbr)"""


def merged(spark, sf):
    return joins.merge_sources(
        b.sales(spark, sf), b.stores(spark, sf), b.oil(spark, sf), b.transactions(spark, sf)
    )


@register(
    "j4_merge_sources",
    "date d, store_nbr i, family s, sales f, onpromotion i, city s, dcoilwtico f, transactions i",
    f"WITH {_MERGED} SELECT * FROM merged",
)
def merge_sources(spark, sf):
    return merged(spark, sf)


@register(
    "j5_holiday_flags",
    "date d, store_nbr i, family s, is_holiday_additional_day i, is_holiday_event i, is_holiday_holiday i",
    f"""WITH {SALES}, {HOLIDAY_ROWS} SELECT date, store_nbr, family,
      CASE WHEN date IN (SELECT date FROM holidays WHERE type = 'Additional Day') THEN 1 ELSE 0 END AS is_holiday_additional_day,
      CASE WHEN date IN (SELECT date FROM holidays WHERE type = 'Event') THEN 1 ELSE 0 END AS is_holiday_event,
      CASE WHEN date IN (SELECT date FROM holidays WHERE type = 'Holiday') THEN 1 ELSE 0 END AS is_holiday_holiday
    FROM sales""",
)
def holiday_flags(spark, sf):
    return features.add_holiday_features(b.sales(spark, sf), holidays=b.holidays(spark, sf))


@register(
    "j6_future_values",
    "store_nbr i, family s, date d, transactions i",
    f"""WITH {SALES}, {TRANSACTIONS}, ends AS (SELECT store_nbr, family, MAX(date) AS last FROM sales GROUP BY 1, 2),
    future AS (SELECT store_nbr, family, CAST(last + CAST(i AS INT) AS DATE) AS date FROM ends, generate_series(1, 28) AS g(i))
    SELECT f.*, transactions FROM future f
    LEFT JOIN transactions t ON f.date = t.date AND f.store_nbr = t.store_nbr""",
)
def future_values(spark, sf):
    future = panel.future_calendar(b.sales(spark, sf), 28)
    return features.future_values(future, b.transactions(spark, sf), ["date", "store_nbr"])


@register(
    "j8_missing_dates",
    "date d",
    f"""WITH {LINES}, returned AS (SELECT DISTINCT date FROM lines WHERE returnflag = 'R' AND discount >= 0.09),
    days AS (SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM returned)
    SELECT date FROM days WHERE date NOT IN (SELECT date FROM returned)""",
)
def missing_dates(spark, sf):
    lines = b.sale_lines(spark, sf).where((F.col("returnflag") == "R") & (F.col("discount") >= 0.09))
    return quality.missing_dates(lines)


@register(
    "j9_known_series",
    "date d, store_nbr i, family s, sales f",
    f"""WITH {SALES} SELECT s.* FROM sales s WHERE (store_nbr, family) IN (
      SELECT (store_nbr, family) FROM sales GROUP BY store_nbr, family HAVING COUNT(*) >= 1300)""",
)
def known_series(spark, sf):
    sales = b.sales(spark, sf)
    trained = sales.groupBy("store_nbr", "family").agg(F.count(F.lit(1)).alias("n")).where("n >= 1300")
    return BoostedModel(None, [], trained.drop("n")).known_rows(sales)


@register("j11_densify", "date d, store_nbr i, family s, sales f", f"WITH {DENSE} SELECT * FROM dense")
def densify(spark, sf):
    return b.dense_sales(spark, sf)


# ---- aggregates


@register("a1_daily_total", "date d, sales f", f"WITH {LINES} SELECT date, SUM(quantity) AS sales FROM lines GROUP BY 1")
def daily_total(spark, sf):
    return panel.daily_total(b.sale_lines(spark, sf).withColumnRenamed("quantity", "sales"))


@register(
    "a2_top_family",
    "store_nbr i, family s, total f",
    f"""WITH {LINES}, t AS (SELECT store_nbr, family, SUM(quantity) AS total FROM lines GROUP BY 1, 2)
    SELECT * FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY store_nbr ORDER BY total DESC, family) = 1""",
)
def top_family(spark, sf):
    return panel.top_series(b.sale_lines(spark, sf), target="quantity")


@register(
    "a3_distinct_keys",
    "key s, value s",
    f"""WITH {LINES} SELECT DISTINCT 'family' AS key, family AS value FROM lines
    UNION ALL SELECT DISTINCT 'store_nbr', CAST(store_nbr AS VARCHAR) FROM lines""",
)
def distinct_keys(spark, sf):
    sales = b.sale_lines(spark, sf)
    parts = [
        panel.distinct_keys(sales, k).select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
        for k in ("family", "store_nbr")
    ]
    return parts[0].unionByName(parts[1])


@register(
    "a4_null_counts",
    "column_name s, nulls i, total_missing i",
    f"""WITH {_MERGED}, n AS (SELECT COUNT(*) - COUNT(dcoilwtico) AS o, COUNT(*) - COUNT(transactions) AS t,
      COUNT(*) - COUNT(sales) AS s FROM merged)
    SELECT UNNEST(['date', 'store_nbr', 'family', 'sales', 'onpromotion', 'city', 'dcoilwtico', 'transactions']) AS column_name,
      UNNEST([0, 0, 0, s, 0, 0, o, t]) AS nulls, s + o + t AS total_missing FROM n""",
)
def null_counts(spark, sf):
    counted = quality.null_counts(merged(spark, sf))
    return counted.select(F.explode("missing_values_count").alias("column_name", "nulls"), "total_missing")


_SIGNED = "CASE WHEN returnflag = 'R' THEN -quantity ELSE quantity END"


def signed_lines(spark, sf):
    """Sale lines with returned quantities as negative sales."""
    amount = F.when(F.col("returnflag") == "R", -F.col("quantity")).otherwise(F.col("quantity"))
    return b.sale_lines(spark, sf).select("date", "store_nbr", "family", amount.alias("sales"))


@register("a5_negative_count", "negative i", f"WITH {LINES} SELECT COUNT(*) AS negative FROM lines WHERE {_SIGNED} < 0")
def negative_count(spark, sf):
    return signed_lines(spark, sf).agg(F.count_if(F.col("sales") < 0).alias("negative"))


@register("a6_date_span", "lo d, hi d", f"WITH {LINES} SELECT MIN(date) AS lo, MAX(date) AS hi FROM lines")
def date_span(spark, sf):
    return b.sale_lines(spark, sf).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))


@register(
    "a7_quartiles_global",
    "q1 f, q3 f",
    "SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem",
)
def quartiles_global(spark, sf):
    q = quantiles.global_quantiles(b.table(spark, sf, "lineitem"), "l_extendedprice", (0.25, 0.75))
    return q.select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))


@register(
    "a7_quartiles_by_series",
    "store_nbr i, family s, q1 f, q3 f",
    f"""WITH {SALES} SELECT store_nbr, family, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3
    FROM sales GROUP BY 1, 2""",
)
def quartiles_by_series(spark, sf):
    q = b.sales(spark, sf).groupBy("store_nbr", "family").agg(quantiles.series_quantiles("sales", (0.25, 0.75)).alias("q"))
    return q.select("store_nbr", "family", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))


@register(
    "a8_column_medians",
    "sales f, onpromotion f",
    f"WITH {SALES} SELECT median(sales) AS sales, median(onpromotion) AS onpromotion FROM sales",
)
def column_medians(spark, sf):
    df = b.sales(spark, sf)
    medians = {c: F.get(quantiles.global_quantiles(df, c, (0.5,)).scalar(), F.lit(0)) for c in ("sales", "onpromotion")}
    return spark.range(1).select(*[m.alias(c) for c, m in medians.items()])


@register(
    "a16_scale_bounds",
    "store_nbr i, family s, sales_min f, sales_max f",
    f"WITH {SALES} SELECT store_nbr, family, MIN(sales) AS sales_min, MAX(sales) AS sales_max FROM sales GROUP BY 1, 2",
)
def scale_bounds(spark, sf):
    return features.scale_bounds(b.sales(spark, sf), ("sales",))


# ---- windows


_LAGS = ", ".join(f"LAG(sales, {k}) OVER {P} AS sales_lag_{k}" for k in (7, 14, 28, 365))
_LAG_SPEC = "sales_lag_7 f, sales_lag_14 f, sales_lag_28 f, sales_lag_365 f"


@register(
    "w1_lag_features",
    f"date d, store_nbr i, family s, {_LAG_SPEC}",
    f"WITH {SALES} SELECT date, store_nbr, family, {_LAGS} FROM sales",
)
def lag_features(spark, sf):
    return features.add_lag_features(b.sales(spark, sf))


def _rolling_sql(size):
    frame = f"(PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    stats = (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"))
    return ", ".join(f"{f}(sales) OVER {frame} AS sales_rolling_{n}_{size}" for n, f in stats)


_ROLL_SPEC = ", ".join(f"sales_rolling_{n}_{s} f" for s in (7, 28) for n in ("mean", "std", "min", "max"))


@register(
    "w2_rolling_features",
    f"date d, store_nbr i, family s, {_ROLL_SPEC}",
    f"WITH {SALES} SELECT date, store_nbr, family, {_rolling_sql(7)}, {_rolling_sql(28)} FROM sales",
)
def rolling_features(spark, sf):
    return features.add_rolling_features(b.sales(spark, sf))


@register(
    "w_lag_and_rolling",
    "date d, store_nbr i, family s, sales f, sales_lag_7 f, sales_rolling_mean_7 f",
    f"""WITH {SALES} SELECT date, store_nbr, family, sales, LAG(sales, 7) OVER {P} AS sales_lag_7,
      AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
        AS sales_rolling_mean_7 FROM sales""",
)
def lag_and_rolling(spark, sf):
    return features.add_series_features(b.sales(spark, sf), lags=(7,), windows=(7,))


_OIL_DAYS = f"""{SALES}, {OIL}, d AS (SELECT DISTINCT date FROM sales),
  p AS (SELECT d.date, LAST_VALUE(o.dcoilwtico IGNORE NULLS) OVER (ORDER BY d.date) AS oil_price
        FROM d LEFT JOIN oil o ON d.date = o.date),
  oil_days AS (SELECT *, LAG(oil_price, 7) OVER (ORDER BY date) AS oil_price_lag_7,
        oil_price / NULLIF(LAG(oil_price, 7) OVER (ORDER BY date), 0) - 1 AS oil_price_change FROM p)"""


@register(
    "w3_w4_oil_by_date",
    "date d, oil_price f, oil_price_lag_7 f, oil_price_change f",
    f"WITH {_OIL_DAYS} SELECT * FROM oil_days",
)
def oil_by_date(spark, sf):
    return features.oil_by_date(joins.merge_sources(b.sales(spark, sf), oil=b.oil(spark, sf)))


def gapped_sales(spark, sf):
    """The dense panel with the days without sales as nulls."""
    return panel.densify(b.sales(spark, sf), fill=None, span="global")


_GAPPED = DENSE + """,
gapped AS (SELECT d.date, s.store_nbr, s.family, p.sales FROM days d CROSS JOIN series s
  LEFT JOIN sales p ON p.date = d.date AND p.store_nbr = s.store_nbr AND p.family = s.family)"""


def _interpolated_sql(partition, order):
    """Linear interpolation in a row order, then the nearest known value."""
    return f"""n AS (SELECT *, ROW_NUMBER() OVER ({partition} ORDER BY {order}) AS pos FROM gapped),
    e AS (SELECT *,
      LAST_VALUE(CASE WHEN sales IS NOT NULL THEN pos END IGNORE NULLS) OVER (
        {partition} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
      LAST_VALUE(sales IGNORE NULLS) OVER ({partition} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
      FIRST_VALUE(CASE WHEN sales IS NOT NULL THEN pos END IGNORE NULLS) OVER (
        {partition} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
      FIRST_VALUE(sales IGNORE NULLS) OVER ({partition} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
      FROM n),
    filled AS (SELECT date, store_nbr, family,
      COALESCE(sales, v0 + (v1 - v0) * ((pos - p0) / CAST(p1 - p0 AS DOUBLE)), v0, v1) AS sales FROM e)"""


@register(
    "w5_interpolate_series",
    "date d, store_nbr i, family s, sales f",
    f"WITH {_GAPPED}, {_interpolated_sql('PARTITION BY store_nbr, family', 'date')} SELECT * FROM filled",
)
def interpolate_series(spark, sf):
    return interpolate_nulls(gapped_sales(spark, sf))


@register(
    "w5_interpolate_global",
    "date d, store_nbr i, family s, sales f",
    f"WITH {_GAPPED}, {_interpolated_sql('', 'date, store_nbr, family')} SELECT * FROM filled",
)
def interpolate_global(spark, sf):
    return interpolate_nulls(gapped_sales(spark, sf), keys=None)


@register(
    "w6_forward_fill",
    "date d, store_nbr i, family s, sales f",
    f"""WITH {_GAPPED} SELECT date, store_nbr, family, LAST_VALUE(sales IGNORE NULLS) OVER {P} AS sales FROM gapped
    QUALIFY date BETWEEN MIN(CASE WHEN sales IS NOT NULL THEN date END) OVER (PARTITION BY store_nbr, family)
      AND MAX(CASE WHEN sales IS NOT NULL THEN date END) OVER (PARTITION BY store_nbr, family)""",
)
def forward_fill(spark, sf):
    return panel.densify(b.sales(spark, sf), fill="ffill")


@register(
    "w7_last_value",
    "store_nbr i, family s, date d, sales f",
    f"WITH {SALES} SELECT store_nbr, family, MAX(date) AS date, ARG_MAX(sales, date) AS sales FROM sales GROUP BY 1, 2",
)
def last_value(spark, sf):
    return panel.last_values(b.sales(spark, sf))


@register(
    "w8_trailing_mean",
    "store_nbr i, family s, mean_28d f",
    f"""WITH {SALES}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_nbr, family ORDER BY date DESC) AS k FROM sales)
    SELECT store_nbr, family, AVG(sales) AS mean_28d FROM r WHERE k <= 28 GROUP BY 1, 2""",
)
def trailing_mean(spark, sf):
    trailing = F.avg("sales").over(panel.series_window().rowsBetween(-27, 0))
    with_mean = b.sales(spark, sf).withColumn("mean_28d", trailing)
    return panel.last_values(with_mean, target="mean_28d")


# ---- order and sets


@register("l1_sorted_panel", "date d, store_nbr i, family s, sales f", f"WITH {SALES} SELECT * FROM sales")
def sorted_panel(spark, sf):
    return b.sales(spark, sf).orderBy(F.col("date").desc(), "store_nbr", "family")


@register(
    "l4_last_rows",
    "store_nbr i, family s, date d, sales f",
    f"""WITH {SALES} SELECT store_nbr, family, date, sales FROM sales
    QUALIFY ROW_NUMBER() OVER (PARTITION BY store_nbr, family ORDER BY date DESC) <= 28""",
)
def last_rows(spark, sf):
    return panel.last_rows(b.sales(spark, sf), 28)


@register(
    "u1_union_by_name",
    "date d, store_nbr i, family s, sales f",
    f"""WITH {SALES} SELECT date, store_nbr, family, sales FROM sales
    UNION ALL SELECT date, store_nbr, 'ALL', SUM(sales) FROM sales GROUP BY 1, 2""",
)
def union_by_name(spark, sf):
    sales = b.sales(spark, sf).drop("onpromotion")
    whole = panel.daily_panel(sales, ("store_nbr",)).withColumn("family", F.lit("ALL"))
    return sales.unionByName(whole)


@register(
    "u2_date_difference",
    "date d",
    f"""WITH {LINES} SELECT DISTINCT date FROM lines
    EXCEPT SELECT date FROM lines WHERE returnflag = 'R' AND discount >= 0.09""",
)
def date_difference(spark, sf):
    lines = b.sale_lines(spark, sf)
    returned = lines.where((F.col("returnflag") == "R") & (F.col("discount") >= 0.09))
    return lines.select("date").subtract(returned.select("date"))


# ---- scalar features


@register(
    "f2_temporal_features",
    "date d, store_nbr i, family s, day_of_week i, day_of_month i, month i, quarter i, year i, week_of_year i, "
    "is_weekend i, is_month_start i, is_month_end i",
    f"""WITH {SALES} SELECT date, store_nbr, family, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month,
      month(date) AS month, quarter(date) AS quarter, year(date) AS year, weekofyear(date) AS week_of_year,
      isodow(date) >= 6 AS is_weekend, day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end FROM sales""",
)
def temporal_features(spark, sf):
    return features.add_temporal_features(b.sales(spark, sf))


@register(
    "f1_cast_dates",
    "day d, n i",
    "SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1",
)
def cast_dates(spark, sf):
    text = b.table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("day"))
    return text.groupBy(F.expr("try_cast(day AS date)").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_PAYDAY = "LEAST(ABS(day(date) - 15), ABS(day(date) - day(last_day(date))))"


@register(
    "f3_days_to_payday",
    "date d, store_nbr i, family s, days_to_payday i",
    f"WITH {SALES} SELECT date, store_nbr, family, {_PAYDAY} AS days_to_payday FROM sales",
)
def days_to_payday(spark, sf):
    return b.sales(spark, sf).withColumn("days_to_payday", features.days_to_payday())


@register(
    "f6_promotion",
    "date d, store_nbr i, family s, onpromotion i",
    f"""WITH {DENSE} SELECT d.date, d.store_nbr, d.family, COALESCE(p.onpromotion, 0) AS onpromotion FROM dense d
    LEFT JOIN sales p ON p.date = d.date AND p.store_nbr = d.store_nbr AND p.family = d.family""",
)
def promotion(spark, sf):
    sparse = panel.densify(b.sales(spark, sf), values=("onpromotion",), fill=None, span="global")
    return features.add_promotion_features(sparse)


_OIL_SPEC = "date d, store_nbr i, family s, oil_price f, oil_price_lag_7 f, oil_price_change f"


@register(
    "f8_oil_by_date",
    _OIL_SPEC,
    f"WITH {_OIL_DAYS} SELECT s.date, store_nbr, family, oil_price, oil_price_lag_7, oil_price_change "
    "FROM sales s JOIN oil_days o ON s.date = o.date",
)
def oil_features_by_date(spark, sf):
    return features.add_oil_features(joins.merge_sources(b.sales(spark, sf), oil=b.oil(spark, sf)))


@register(
    "f8_oil_by_row",
    _OIL_SPEC,
    f"""WITH {_WITH_OIL}, p AS (SELECT *, LAST_VALUE(dcoilwtico IGNORE NULLS) OVER w AS oil_price FROM m
      WINDOW w AS (ORDER BY date, store_nbr, family ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT *, LAG(oil_price, 7) OVER w AS oil_price_lag_7,
      oil_price / NULLIF(LAG(oil_price, 7) OVER w, 0) - 1 AS oil_price_change FROM p
    WINDOW w AS (ORDER BY date, store_nbr, family)""",
)
def oil_features_by_row(spark, sf):
    return features.add_oil_features(joins.merge_sources(b.sales(spark, sf), oil=b.oil(spark, sf)), by="row")


_ALL_SPEC = (
    "date d, store_nbr i, family s, sales f, onpromotion i, city s, transactions i, day_of_week i, day_of_month i, "
    "month i, quarter i, year i, week_of_year i, is_weekend i, is_month_start i, is_month_end i, "
    f"{_LAG_SPEC}, {_ROLL_SPEC}, is_holiday_additional_day i, is_holiday_event i, is_holiday_holiday i, "
    "days_to_payday i, oil_price f, oil_price_lag_7 f, oil_price_change f"
)


@register(
    "f9_all_features",
    _ALL_SPEC,
    f"""WITH {_MERGED}, {HOLIDAY_ROWS}, d AS (SELECT DISTINCT date FROM sales),
    p AS (SELECT d.date, LAST_VALUE(o.dcoilwtico IGNORE NULLS) OVER (ORDER BY d.date) AS oil_price
          FROM d LEFT JOIN oil o ON d.date = o.date),
    oil_days AS (SELECT *, LAG(oil_price, 7) OVER (ORDER BY date) AS oil_price_lag_7,
          oil_price / NULLIF(LAG(oil_price, 7) OVER (ORDER BY date), 0) - 1 AS oil_price_change FROM p)
    SELECT m.*, isodow(m.date) - 1 AS day_of_week, day(m.date) AS day_of_month, month(m.date) AS month,
      quarter(m.date) AS quarter, year(m.date) AS year, weekofyear(m.date) AS week_of_year,
      isodow(m.date) >= 6 AS is_weekend, day(m.date) = 1 AS is_month_start, m.date = last_day(m.date) AS is_month_end,
      {_LAGS.replace("ORDER BY date", "ORDER BY m.date")},
      {_rolling_sql(7).replace("ORDER BY date", "ORDER BY m.date")},
      {_rolling_sql(28).replace("ORDER BY date", "ORDER BY m.date")},
      CASE WHEN m.date IN (SELECT date FROM holidays WHERE type = 'Additional Day') THEN 1 ELSE 0 END AS is_holiday_additional_day,
      CASE WHEN m.date IN (SELECT date FROM holidays WHERE type = 'Event') THEN 1 ELSE 0 END AS is_holiday_event,
      CASE WHEN m.date IN (SELECT date FROM holidays WHERE type = 'Holiday') THEN 1 ELSE 0 END AS is_holiday_holiday,
      {_PAYDAY.replace("date)", "m.date)")} AS days_to_payday, oil_price, oil_price_lag_7, oil_price_change
    FROM merged m JOIN oil_days o ON m.date = o.date""",
)
def all_features(spark, sf):
    return features.engineer_all_features(merged(spark, sf), b.holidays(spark, sf), b.HOLIDAY_TYPES)


@register(
    "f10_min_max_scale",
    "date d, store_nbr i, family s, sales_scaled f",
    f"""WITH {SALES} SELECT date, store_nbr, family, (sales - MIN(sales) OVER k) / (MAX(sales) OVER k - MIN(sales) OVER k + 1e-8)
      AS sales_scaled FROM sales WINDOW k AS (PARTITION BY store_nbr, family)""",
)
def min_max_scale(spark, sf):
    return features.min_max_scale(b.sales(spark, sf))


@register(
    "f7_clip",
    "date d, store_nbr i, family s, sales f",
    f"WITH {SALES} SELECT date, store_nbr, family, LEAST(GREATEST(sales, 5), 60) AS sales FROM sales",
)
def clip(spark, sf):
    clipped = F.least(F.greatest(F.col("sales"), F.lit(5.0)), F.lit(60.0))
    return b.sales(spark, sf).withColumn("sales", clipped)


@register(
    "f11_arithmetic",
    "date d, store_nbr i, family s, ape f, se f, rt f",
    f"""WITH {SALES}, l AS (SELECT *, LAG(sales, 7) OVER {P} AS yhat FROM sales)
    SELECT date, store_nbr, family, ABS((sales - yhat) / NULLIF(sales, 0)) * 100 AS ape,
      (sales - yhat) * (sales - yhat) AS se, SQRT(ABS(sales - yhat)) AS rt FROM l""",
)
def arithmetic(spark, sf):
    df = features.add_lag_features(b.sales(spark, sf), lags=(7,))
    error = F.col("sales") - F.col("sales_lag_7")
    return df.select(
        "date",
        "store_nbr",
        "family",
        (F.abs(F.try_divide(error, F.col("sales"))) * 100).alias("ape"),
        F.pow(error, 2).alias("se"),
        F.sqrt(F.abs(error)).alias("rt"),
    )


@register(
    "f12_text",
    "family s, safe s, n i",
    f"""WITH {SALES} SELECT family, REPLACE(REPLACE(LOWER(family), '/', '_'), ' ', '_') AS safe, COUNT(*) AS n
    FROM sales GROUP BY 1, 2""",
)
def text(spark, sf):
    safe = F.replace(F.replace(F.lower("family"), F.lit("/"), F.lit("_")), F.lit(" "), F.lit("_"))
    return b.sales(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("safe", safe)


@register(
    "f13_date_arithmetic",
    "date d, store_nbr i, family s, text s, next_week d, next_year d",
    f"""WITH {SALES} SELECT date, store_nbr, family, STRFTIME(date, '%Y-%m-%d') AS text,
      CAST(date + 7 AS DATE) AS next_week, CAST(date + INTERVAL 12 MONTH AS DATE) AS next_year FROM sales""",
)
def date_arithmetic(spark, sf):
    return b.sales(spark, sf).withColumns(
        {
            "text": F.date_format("date", "yyyy-MM-dd"),
            "next_week": F.date_add("date", 7),
            "next_year": F.add_months("date", 12),
        }
    )


@register(
    "f14_future_calendar",
    "store_nbr i, family s, date d",
    f"""WITH {SALES}, ends AS (SELECT store_nbr, family, MAX(date) AS last FROM sales GROUP BY 1, 2)
    SELECT store_nbr, family, CAST(last + CAST(i AS INT) AS DATE) AS date FROM ends, generate_series(1, 28) AS g(i)""",
)
def future_calendar(spark, sf):
    return panel.future_calendar(b.sales(spark, sf), 28)


@register(
    "w_global_row_lag",
    "date d, store_nbr i, family s, pos i, earlier f",
    f"""WITH {SALES} SELECT date, store_nbr, family, ROW_NUMBER() OVER w AS pos, LAG(sales, 7) OVER w AS earlier
    FROM sales WINDOW w AS (ORDER BY date, store_nbr, family)""",
)
def global_row_lag(spark, sf):
    numbered = ordered_scan(b.sales(spark, sf), ("date", "store_nbr", "family"), "sales")
    return global_lag(numbered, "sales", 7, "earlier")
