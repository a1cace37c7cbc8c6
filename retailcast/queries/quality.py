"""Validation, anomalies and seasonality."""

from pyspark.sql import functions as F

from retailcast.operators import anomaly, forest, quality, seasonality
from retailcast.plans import bindings as b
from retailcast.plans import reports
from retailcast.queries.registry import register
from retailcast.queries.shaping import P, signed_lines
from retailcast.queries.tables import DENSE, LINES, SALES

_SIGNED = LINES + """,
signed AS (SELECT date, store_nbr, family, CASE WHEN returnflag = 'R' THEN -quantity ELSE quantity END AS sales FROM lines)"""


@register(
    "v1_validate_table",
    "is_valid b, n_missing_dates i, first_missing s, null_sales i, negative_sales_count i, warnings s",
    f"""WITH {_SIGNED},
    days AS (SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM signed),
    gaps AS (SELECT COUNT(*) AS g, MIN(date) AS first FROM days WHERE date NOT IN (SELECT date FROM signed)),
    n AS (SELECT COUNT(*) - COUNT(sales) AS nulls, SUM(CASE WHEN sales < 0 THEN 1 ELSE 0 END) AS neg FROM signed)
    SELECT g = 0 AND neg = 0 AS is_valid, g AS n_missing_dates, CAST(first AS VARCHAR) AS first_missing,
      nulls AS null_sales, neg AS negative_sales_count,
      CONCAT_WS('; ', CASE WHEN g > 0 THEN 'Found ' || g || ' missing dates in time series' END,
        CASE WHEN neg > 0 THEN 'Found ' || CAST(neg AS BIGINT) || ' rows with negative sales' END) AS warnings
    FROM gaps, n""",
)
def validate_table(spark, sf):
    result = quality.validate_sales_data(signed_lines(spark, sf))
    return result.select(
        "is_valid",
        F.size("missing_dates").alias("n_missing_dates"),
        F.get("missing_dates", F.lit(0)).alias("first_missing"),
        F.col("missing_values_count")["sales"].alias("null_sales"),
        "negative_sales_count",
        F.concat_ws("; ", "warnings").alias("warnings"),
    )


@register(
    "v1_validate_series",
    "store_nbr i, family s, is_valid b, missing s, negative_sales_count i",
    f"""WITH {_SIGNED}, r AS (SELECT store_nbr, family, MIN(date) AS lo, MAX(date) AS hi,
      SUM(CASE WHEN sales < 0 THEN 1 ELSE 0 END) AS neg FROM signed GROUP BY 1, 2),
    days AS (SELECT store_nbr, family, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM r),
    gaps AS (SELECT d.store_nbr, d.family, COUNT(*) AS g, STRING_AGG(CAST(d.date AS VARCHAR), ',' ORDER BY d.date) AS missing
      FROM days d LEFT JOIN (SELECT DISTINCT store_nbr, family, date FROM signed) s
        ON s.date = d.date AND s.store_nbr = d.store_nbr AND s.family = d.family
      WHERE s.date IS NULL GROUP BY 1, 2)
    SELECT r.store_nbr, r.family, COALESCE(g, 0) = 0 AND neg = 0 AS is_valid, COALESCE(missing, '') AS missing,
      neg AS negative_sales_count FROM r LEFT JOIN gaps ON r.store_nbr = gaps.store_nbr AND r.family = gaps.family""",
)
def validate_series(spark, sf):
    result = quality.validate_sales_data(signed_lines(spark, sf), keys=("store_nbr", "family"))
    return result.withColumn("missing", F.concat_ws(",", "missing_dates"))


# ---- anomalies

_KEY = "PARTITION BY store_nbr, family"


def _flagged_sql(by_series, multiplier=1.5):
    q = (
        f"q AS (SELECT store_nbr, family, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3 "
        f"FROM sales GROUP BY 1, 2)"
        if by_series
        else "q AS (SELECT quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3 FROM sales)"
    )
    on = "ON s.store_nbr = q.store_nbr AND s.family = q.family" if by_series else "ON TRUE"
    return f"""{SALES}, {q}, flagged AS (SELECT s.*,
      s.sales < q1 - {multiplier} * (q3 - q1) OR s.sales > q3 + {multiplier} * (q3 - q1) AS anomaly_iqr,
      q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM sales s JOIN q {on})"""


_FLAG_SPEC = "date d, store_nbr i, family s, sales f, anomaly_iqr b"


@register("n1_iqr_global", _FLAG_SPEC, f"WITH {_flagged_sql(False)} SELECT * FROM flagged")
def iqr_global(spark, sf):
    return anomaly.detect_iqr(b.sales(spark, sf))


@register("n1_iqr_by_series", _FLAG_SPEC, f"WITH {_flagged_sql(True)} SELECT * FROM flagged")
def iqr_by_series(spark, sf):
    return anomaly.detect_iqr(b.sales(spark, sf), keys=("store_nbr", "family"))


FOREST_FEATURES = ("sales", "onpromotion")


def _forest_sql() -> str:
    """The trees of the forest over sales and promotions, grown level by level, and the score of every row.

    Ends in ``scored``: the rows of ``sales`` with their score and the cut-off.
    """
    f = anomaly.IsolationForest()
    limit, p = (f.sample_size - 1).bit_length(), forest.PRIME
    part = lambda text, at: f"CAST('0x' || substr({text}, {at}, 8) AS BIGINT)"
    path = lambda c: (
        f"CASE WHEN {c} > 2 THEN 2.0::DOUBLE * (ln({c} - 1.0::DOUBLE) + {forest.EULER_GAMMA!r}::DOUBLE) "
        f"- 2.0::DOUBLE * ({c} - 1.0::DOUBLE) / {c} WHEN {c} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    )
    ctes = [
        SALES,
        """m AS (SELECT quantile_cont(sales, 0.5) AS m0, quantile_cont(CAST(onpromotion AS DOUBLE), 0.5) AS m1, COUNT(*) AS n
          FROM sales)""",
        f"""pool AS (SELECT date, store_nbr, family, CAST(COALESCE(sales, m0) AS DOUBLE) AS x0, CAST(COALESCE(onpromotion, m1) AS DOUBLE) AS x1,
          md5(concat(CAST(date AS VARCHAR), '|', CAST(store_nbr AS VARCHAR), '|', family, '|{f.seed}')) AS h, n FROM sales, m)""",
        f"""hits AS (SELECT tree, x0, x1, ({part("h", 1)} % {p} + tree * ({part("h", 9)} % {p})) % {p} AS v, n
          FROM pool, (SELECT UNNEST(range({f.n_trees})) AS tree) t)""",
        f"""drawn AS (SELECT tree, 1::BIGINT AS node, x0, x1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY v, x0, x1) AS place
          FROM hits WHERE v < ceil({p} * least(1.0::DOUBLE, {forest.HITS * f.sample_size}::DOUBLE / n))) WHERE place <= {f.sample_size})""",
        "p0 AS (SELECT * FROM drawn)",
    ]
    for k in range(limit + 1):
        inner = "c > 1 AND (hi0 > lo0 OR hi1 > lo1)" if k < limit else "FALSE"
        ctes += [
            f"""g{k} AS (SELECT *, {inner} AS inner_node, md5(concat('{f.seed}:', tree, ':', node)) AS h FROM (SELECT tree, node, COUNT(*) AS c,
              MIN(x0) AS lo0, MAX(x0) AS hi0, MIN(x1) AS lo1, MAX(x1) AS hi1 FROM p{k} GROUP BY 1, 2))""",
            f"""f{k} AS (SELECT *, CASE WHEN hi0 > lo0 AND hi1 > lo1
              THEN CAST(floor({part("h", 1)} / 4294967296.0::DOUBLE * 2) AS INT) WHEN hi0 > lo0 THEN 0 ELSE 1 END AS f FROM g{k})""",
            f"""c{k} AS (SELECT tree, node, c, inner_node, f, CASE WHEN cut >= hi THEN lo ELSE cut END AS cut, {k} + {path("c")} AS depth
              FROM (SELECT *, lo + {part("h", 9)} / 4294967296.0::DOUBLE * (hi - lo) AS cut FROM
              (SELECT *, CASE f WHEN 0 THEN lo0 ELSE lo1 END AS lo, CASE f WHEN 0 THEN hi0 ELSE hi1 END AS hi FROM f{k})))""",
        ]
        if k < limit:
            ctes.append(f"""p{k + 1} AS (SELECT p.tree, 2 * p.node + CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END > cut THEN 1 ELSE 0 END AS node, x0, x1
              FROM p{k} p JOIN c{k} c ON c.tree = p.tree AND c.node = p.node AND c.inner_node)""")
    nodes = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(limit + 1))
    walk = ["w0 AS (SELECT x0, x1, tree, 1::BIGINT AS node, 0.0::DOUBLE AS depth, TRUE AS going FROM (SELECT DISTINCT x0, x1 FROM pool), (SELECT DISTINCT tree FROM drawn))"]
    for k in range(limit + 1):
        # a walk that reached a leaf stays as it is
        walk.append(f"""w{k + 1} AS (SELECT x0, x1, w.tree, CASE WHEN going AND inner_node
          THEN 2 * w.node + CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END > cut THEN 1 ELSE 0 END ELSE w.node END AS node,
          CASE WHEN going AND NOT inner_node THEN n.depth ELSE w.depth END AS depth, going AND inner_node AS going
          FROM w{k} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node)""")
    ctes += [
        f"nodes AS MATERIALIZED ({nodes})",
        *walk,
        f"unit AS (SELECT {path('MAX(c)')} AS unit FROM c0)",
        f"""scores AS (SELECT x0, x1, round(pow(2.0::DOUBLE, -SUM(depth) / (COUNT(*) * greatest(MAX(unit), 1e-12::DOUBLE))) * 1e12) / 1e12 AS score
          FROM w{limit + 1}, unit GROUP BY 1, 2)""",
        "rows_scored AS (SELECT date, store_nbr, family, score FROM pool JOIN scores USING (x0, x1))",
        f"""scored AS (SELECT s.*, r.score, r.score > cut AS anomaly_if FROM sales s JOIN rows_scored r USING (date, store_nbr, family),
          (SELECT quantile_cont(score, {1.0 - f.contamination!r}::DOUBLE) AS cut FROM rows_scored))""",
    ]
    return ", ".join(ctes)


FOREST_SQL = _forest_sql()


@register(
    "n2_isolation_forest",
    "date d, store_nbr i, family s, sales f, onpromotion i, anomaly_if b",
    f"WITH {FOREST_SQL} SELECT * FROM scored",
)
def isolation_forest(spark, sf):
    df = b.sales(spark, sf).persist()  # read for the medians, the sample, the scores and the cut-off
    grown = anomaly.IsolationForest().fit(df, FOREST_FEATURES, ("date", "store_nbr", "family"))
    return grown.flag(df)


@register(
    "n3_detect_iqr_only",
    "date d, store_nbr i, family s, anomaly_iqr b, anomaly_if b, is_anomaly b",
    f"WITH {_flagged_sql(False)} SELECT *, FALSE AS anomaly_if, anomaly_iqr AS is_anomaly FROM flagged",
)
def detect_iqr_only(spark, sf):
    return anomaly.detect_anomalies(b.sales(spark, sf))


@register(
    "n3_detect_both",
    "date d, store_nbr i, family s, anomaly_iqr b, anomaly_if b, is_anomaly b",
    f"""WITH {FOREST_SQL}, {_flagged_sql(False).removeprefix(SALES + ", ")}
    SELECT date, store_nbr, family, f.anomaly_iqr, s.anomaly_if, f.anomaly_iqr OR s.anomaly_if AS is_anomaly
    FROM flagged f JOIN scored s USING (date, store_nbr, family)""",
)
def detect_both(spark, sf):
    return anomaly.detect_anomalies(b.sales(spark, sf).persist(), multivariate_features=FOREST_FEATURES)


_ROW_SPEC = "date d, store_nbr i, family s, sales f"


def _detected(spark, sf, by_series=False):
    return anomaly.detect_anomalies(b.sales(spark, sf), keys=("store_nbr", "family") if by_series else None)


@register("n4_remove", _ROW_SPEC, f"WITH {_flagged_sql(False)} SELECT * FROM flagged WHERE NOT anomaly_iqr")
def remove(spark, sf):
    return anomaly.handle_anomalies(_detected(spark, sf), "remove")


def _repaired_sql(by_series):
    part = _KEY if by_series else ""
    order = "date" if by_series else "date, store_nbr, family"
    return f"""{_flagged_sql(by_series)}, n AS (SELECT *, CASE WHEN NOT anomaly_iqr THEN sales END AS v,
      ROW_NUMBER() OVER ({part} ORDER BY {order}) AS pos FROM flagged),
    e AS (SELECT *,
      LAST_VALUE(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER ({part} ORDER BY pos) AS p0,
      LAST_VALUE(v IGNORE NULLS) OVER ({part} ORDER BY pos) AS v0,
      FIRST_VALUE(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER (
        {part} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
      FIRST_VALUE(v IGNORE NULLS) OVER ({part} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
      FROM n),
    repaired AS (SELECT *, COALESCE(v, v0 + (v1 - v0) * ((pos - p0) / CAST(p1 - p0 AS DOUBLE)), v0, v1) AS new_value FROM e)"""


@register(
    "n5_interpolate_global",
    _ROW_SPEC,
    f"WITH {_repaired_sql(False)} SELECT date, store_nbr, family, new_value AS sales FROM repaired",
)
def interpolate_global(spark, sf):
    return anomaly.handle_anomalies(_detected(spark, sf), "interpolate")


@register(
    "n5_interpolate_by_series",
    _ROW_SPEC,
    f"WITH {_repaired_sql(True)} SELECT date, store_nbr, family, new_value AS sales FROM repaired",
)
def interpolate_by_series(spark, sf):
    return anomaly.handle_anomalies(_detected(spark, sf, True), "interpolate", keys=("store_nbr", "family"))


@register(
    "n6_cap",
    _ROW_SPEC,
    f"WITH {_flagged_sql(False)} SELECT date, store_nbr, family, LEAST(GREATEST(sales, lo), hi) AS sales FROM flagged",
)
def cap(spark, sf):
    return anomaly.handle_anomalies(_detected(spark, sf), "cap")


@register(
    "n6_cap_by_series",
    _ROW_SPEC,
    f"WITH {_flagged_sql(True)} SELECT date, store_nbr, family, LEAST(GREATEST(sales, lo), hi) AS sales FROM flagged",
)
def cap_by_series(spark, sf):
    return anomaly.handle_anomalies(_detected(spark, sf, True), "cap", keys=("store_nbr", "family"))


_RECORD_SPEC = "date s, store_nbr i, family s, original_value f, method s, action s, new_value f"
_RECORDS = f"""{_repaired_sql(True)}, records AS (
  SELECT CAST(date AS VARCHAR) AS date, store_nbr, family, sales AS original_value, 'iqr' AS method,
    'interpolate' AS action, new_value FROM repaired WHERE anomaly_iqr)"""


def records(spark, sf):
    return anomaly.anomaly_records(_detected(spark, sf, True), "interpolate", keys=("store_nbr", "family"))


@register("n7_anomaly_records", _RECORD_SPEC, f"WITH {_RECORDS} SELECT * FROM records")
def anomaly_records(spark, sf):
    return records(spark, sf)


@register(
    "n7_records_of_removed",
    _RECORD_SPEC,
    f"""WITH {_flagged_sql(False)} SELECT CAST(date AS VARCHAR) AS date, store_nbr, family, sales AS original_value,
    'iqr' AS method, 'remove' AS action, NULL AS new_value FROM flagged WHERE anomaly_iqr""",
)
def records_of_removed(spark, sf):
    return anomaly.anomaly_records(_detected(spark, sf), "remove")


@register(
    "u4_either_detector",
    "store_nbr i, family s, n_iqr i, n_promoted i, n_either i",
    f"""WITH {_flagged_sql(True)} SELECT store_nbr, family, COUNT(*) FILTER (anomaly_iqr) AS n_iqr,
      COUNT(*) FILTER (onpromotion >= 4) AS n_promoted, COUNT(*) FILTER (anomaly_iqr OR onpromotion >= 4) AS n_either
    FROM flagged GROUP BY 1, 2""",
)
def either_detector(spark, sf):
    flagged = anomaly.detect_iqr(b.sales(spark, sf), keys=("store_nbr", "family"))
    promoted = F.col("onpromotion") >= 4
    return flagged.groupBy("store_nbr", "family").agg(
        F.count_if("anomaly_iqr").alias("n_iqr"),
        F.count_if(promoted).alias("n_promoted"),
        F.count_if(F.col("anomaly_iqr") | promoted).alias("n_either"),
    )


@register(
    "a13_anomaly_counts",
    "total i, iqr i, isolation_forest i",
    f"WITH {_RECORDS} SELECT COUNT(*) AS total, COUNT(*) AS iqr, 0 AS isolation_forest FROM records",
)
def anomaly_counts(spark, sf):
    return anomaly.anomaly_counts(records(spark, sf))


@register(
    "a13_anomaly_rollup",
    "store_nbr i, family s, method s, n i",
    f"""WITH {_RECORDS} SELECT store_nbr, family, method, COUNT(*) AS n FROM records
    GROUP BY ROLLUP (store_nbr, family, method)""",
)
def anomaly_rollup(spark, sf):
    return reports.anomaly_rollup(records(spark, sf))


@register(
    "t7_anomaly_explorer",
    _RECORD_SPEC,
    f"WITH {_RECORDS} SELECT * FROM records WHERE store_nbr = 2 AND method = 'iqr'",
)
def anomaly_explorer(spark, sf):
    return reports.anomaly_details(records(spark, sf), store=2, family="All", method="iqr")


# ---- seasonality

_SPECTRUM = f"""{DENSE}, t AS (SELECT store_nbr, family, sales, ROW_NUMBER() OVER {P} - 1 AS t FROM dense),
  s AS (SELECT store_nbr, family, COUNT(*) AS n, AVG(sales) AS m FROM t GROUP BY 1, 2),
  f AS (SELECT store_nbr, family, n, m, UNNEST(generate_series(1, (n - 1) // 2)) AS k FROM s),
  spec AS (SELECT f.store_nbr, f.family, k, ANY_VALUE(n) AS n, ANY_VALUE(k * (1.0::DOUBLE / n)) AS frequency,
    SQRT(POW(SUM((sales - m) * COS(2 * PI() * ((k * t) % n) / n)), 2) +
         POW(SUM((sales - m) * SIN(2 * PI() * ((k * t) % n) / n)), 2)) AS magnitude
    FROM f JOIN t ON f.store_nbr = t.store_nbr AND f.family = t.family GROUP BY 1, 2, 3)"""


@register(
    "y1_spectrum",
    "store_nbr i, family s, k i, n i, frequency f, magnitude f2",
    f"WITH {_SPECTRUM} SELECT * FROM spec",
)
def spectrum(spark, sf):
    return seasonality.spectrum(b.dense_sales(spark, sf))


_PEAKS = f"""{_SPECTRUM}, p AS (SELECT *, LAG(magnitude) OVER w AS a, LEAD(magnitude) OVER w AS z,
    AVG(magnitude) OVER ({_KEY}) AS mean, MAX(magnitude) OVER ({_KEY}) AS top FROM spec
    WINDOW w AS ({_KEY} ORDER BY k)),
  peaks AS (SELECT store_nbr, family, k, CAST(TRUNC(1 / frequency) AS INT) AS period, magnitude / top AS strength FROM p
    WHERE a < magnitude AND z < magnitude AND magnitude >= mean
    QUALIFY ROW_NUMBER() OVER ({_KEY} ORDER BY k) <= 5)"""


@register(
    "y2_spectral_peaks",
    "store_nbr i, family s, k i, period i, strength f4",
    f"WITH {_PEAKS} SELECT * FROM peaks",
)
def spectral_peaks(spark, sf):
    return seasonality.spectral_peaks(seasonality.spectrum(b.dense_sales(spark, sf)))


_LAGGED = f"""centred AS (SELECT store_nbr, family, sales - AVG(sales) OVER ({_KEY}) AS x,
    ROW_NUMBER() OVER {P} AS t, COUNT(*) OVER ({_KEY}) AS n FROM dense),
  l AS (SELECT UNNEST(generate_series(0, 400)) AS lag),
  acf AS (SELECT a.store_nbr, a.family, lag, SUM(a.x * z.x) / ANY_VALUE(v.v) AS acf FROM centred a CROSS JOIN l
    JOIN centred z ON a.store_nbr = z.store_nbr AND a.family = z.family AND z.t = a.t + lag
    JOIN (SELECT store_nbr, family, SUM(x * x) AS v FROM centred GROUP BY 1, 2) v
      ON a.store_nbr = v.store_nbr AND a.family = v.family
    WHERE lag <= a.n // 2 - 1 GROUP BY 1, 2, 3)"""
_ACF = f"{DENSE}, {_LAGGED}"


def _levinson(acf: str, days: str, last: str) -> str:
    """CTE ``steps``: the last coefficient of every order up to ``last``, by the Levinson-Durbin recursion over the
    autocorrelations of ``acf`` with divisor n - lag; ``days`` has the rows of each series."""
    return f"""n AS (SELECT store_nbr, family, COUNT(*) AS n FROM {days} GROUP BY 1, 2),
  r AS MATERIALIZED (SELECT a.store_nbr, a.family, {last} AS last_lag, LIST(acf * n / (n - lag) ORDER BY lag) AS r
    FROM {acf} a JOIN n ON a.store_nbr = n.store_nbr AND a.family = n.family WHERE lag <= {last} GROUP BY 1, 2, 3),
  steps AS (SELECT *, 0 AS lag, CAST([] AS DOUBLE[]) AS phi, r[1] AS error, CAST(1 AS DOUBLE) AS pacf FROM r
    UNION ALL SELECT store_nbr, family, last_lag, r, lag + 1,
      list_append([phi[j] - c * phi[lag + 1 - j] FOR j IN range(1, lag + 1)], c), error * (1 - c * c), c
    FROM (SELECT *, (r[lag + 2] - COALESCE(list_sum([phi[j] * r[lag + 2 - j] FOR j IN range(1, lag + 1)]), 0)) / error AS c
      FROM steps WHERE lag < last_lag) o)"""




@register("y3_acf", "store_nbr i, family s, lag i, acf f", f"WITH {_ACF} SELECT * FROM acf")
def acf(spark, sf):
    return seasonality.correlogram(b.dense_sales(spark, sf))


@register(
    "y4_pacf",
    "store_nbr i, family s, lag i, pacf f",
    f"""WITH RECURSIVE {_ACF}, {_levinson("acf", "dense", "LEAST(50, n // 4)")}
    SELECT store_nbr, family, lag, pacf FROM steps WHERE pacf IS NOT NULL AND NOT ISNAN(pacf)""",
)
def pacf(spark, sf):
    return seasonality.correlogram(b.dense_sales(spark, sf)).where("pacf is not null")


@register(
    "y5_strengths",
    "store_nbr i, family s, weekly_strength f, monthly_strength f, yearly_strength f",
    f"""WITH {_ACF} SELECT store_nbr, family, COALESCE(MAX(acf) FILTER (lag = 7), 0) AS weekly_strength,
      COALESCE(MAX(acf) FILTER (lag = 30), 0) AS monthly_strength,
      COALESCE(MAX(acf) FILTER (lag = 365), 0) AS yearly_strength FROM acf GROUP BY 1, 2""",
)
def strengths(spark, sf):
    return seasonality.analyze(b.dense_sales(spark, sf))


@register(
    "y5_analyze",
    "store_nbr i, family s, periods s, weekly_strength f, n_acf i, n_pacf i",
    f"""WITH {_PEAKS}, {_LAGGED},
    ranked AS (SELECT store_nbr, family, STRING_AGG(CAST(period AS VARCHAR), ',' ORDER BY strength DESC, k) AS periods
      FROM peaks GROUP BY 1, 2),
    listed AS (SELECT store_nbr, family, COALESCE(MAX(acf) FILTER (lag = 7), 0) AS weekly_strength, COUNT(*) AS n_acf
      FROM acf GROUP BY 1, 2)
    SELECT a.store_nbr, a.family, COALESCE(periods, '') AS periods, weekly_strength, n_acf, LEAST(50, s.n // 4) + 1 AS n_pacf
    FROM listed a JOIN s ON a.store_nbr = s.store_nbr AND a.family = s.family
    LEFT JOIN ranked r ON a.store_nbr = r.store_nbr AND a.family = r.family""",
)
def analyze(spark, sf):
    return seasonality.analyze(b.dense_sales(spark, sf)).withColumns(
        {
            "periods": F.concat_ws(",", F.transform("dominant_periods", lambda p: p.cast("string"))),
            "n_acf": F.size("acf_values"),
            "n_pacf": F.size("pacf_values"),
        }
    )


_FILLED = f"""{DENSE}, ranges AS (SELECT store_nbr, family, MIN(date) AS lo, MAX(date) AS hi FROM sales GROUP BY 1, 2),
  filled AS (SELECT d.date, d.store_nbr, d.family, LAST_VALUE(p.sales IGNORE NULLS) OVER (
      PARTITION BY d.store_nbr, d.family ORDER BY d.date) AS sales
    FROM dense d JOIN ranges r ON d.store_nbr = r.store_nbr AND d.family = r.family AND d.date BETWEEN lo AND hi
    LEFT JOIN sales p ON p.date = d.date AND p.store_nbr = d.store_nbr AND p.family = d.family)"""

_DECOMPOSED = f"""{_FILLED}, t AS (SELECT *, ROW_NUMBER() OVER {P} - 1 AS t,
    CASE WHEN COUNT(*) OVER w = 7 THEN SUM(sales) OVER w / 7 END AS trend, COUNT(*) OVER ({_KEY}) AS n FROM filled
    WINDOW w AS ({_KEY} ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  m AS (SELECT store_nbr, family, t % 7 AS p, AVG(sales - trend) AS mean FROM t GROUP BY 1, 2, 3),
  c AS (SELECT *, mean - AVG(mean) OVER ({_KEY}) AS seasonal FROM m),
  parts AS (SELECT t.store_nbr, t.family, date, sales, trend, seasonal, sales - trend - seasonal AS resid
    FROM t JOIN c ON t.store_nbr = c.store_nbr AND t.family = c.family AND t.t % 7 = c.p WHERE n >= 14)"""


@register(
    "y6_decompose",
    "store_nbr i, family s, date d, sales f, trend f, seasonal f, resid f",
    f"WITH {_DECOMPOSED} SELECT * FROM parts",
)
def decompose(spark, sf):
    return seasonality.decompose(b.sales(spark, sf))


@register(
    "w9_centred_mean",
    "store_nbr i, family s, date d, trend f",
    f"WITH {_DECOMPOSED} SELECT store_nbr, family, date, trend FROM parts WHERE trend IS NOT NULL",
)
def centred_mean(spark, sf):
    return seasonality.decompose(b.sales(spark, sf)).where("trend is not null")


_REPORT_ACF = f"""{_FILLED}, t AS (SELECT store_nbr, family, sales - AVG(sales) OVER ({_KEY}) AS x,
      ROW_NUMBER() OVER {P} AS t, COUNT(*) OVER ({_KEY}) AS n FROM filled),
    l AS (SELECT UNNEST(generate_series(0, 50)) AS lag),
    report AS (
    SELECT a.store_nbr, a.family, lag, SUM(a.x * z.x) / ANY_VALUE(v.v) AS acf, ANY_VALUE(1.96 / SQRT(a.n)) AS band
    FROM t a CROSS JOIN l JOIN t z ON a.store_nbr = z.store_nbr AND a.family = z.family AND z.t = a.t + lag
    JOIN (SELECT store_nbr, family, SUM(x * x) AS v FROM t GROUP BY 1, 2) v
      ON a.store_nbr = v.store_nbr AND a.family = v.family
    WHERE lag <= a.n // 2 - 1 GROUP BY 1, 2, 3)"""


@register("y7_report_acf", "store_nbr i, family s, lag i, acf f, band f", f"WITH {_REPORT_ACF} SELECT * FROM report")
def report_acf(spark, sf):
    return seasonality.report_correlogram(b.sales(spark, sf))


@register(
    "t8_seasonality_page",
    "store_nbr i, family s, lag i, acf f, pacf f, band f",
    f"""WITH RECURSIVE {_REPORT_ACF}, {_levinson("report", "t", "GREATEST(1, LEAST(50, n // 2 - 1, n // 4))")}
    SELECT p.store_nbr, p.family, p.lag, acf, CASE WHEN NOT ISNAN(pacf) THEN pacf END AS pacf, band
    FROM report p LEFT JOIN steps s ON p.store_nbr = s.store_nbr AND p.family = s.family AND p.lag = s.lag""",
)
def seasonality_page(spark, sf):
    return seasonality.report_correlogram(b.sales(spark, sf))
