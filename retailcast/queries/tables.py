"""SQL for the retail tables, as common table expressions for the oracle queries."""

from retailcast.plans.bindings import HOLIDAYS

LINES = """lines AS (
  SELECT CAST(l_shipdate AS DATE) AS date, n_regionkey AS store_nbr, p_type AS family,
         l_quantity AS quantity, l_discount AS discount, l_returnflag AS returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey
                JOIN part ON l_partkey = p_partkey)"""

SALES = LINES + """,
sales AS (
  SELECT date, store_nbr, family, SUM(quantity) AS sales,
         CAST(SUM(CASE WHEN discount >= 0.07 THEN 1 ELSE 0 END) AS INT) AS onpromotion
  FROM lines GROUP BY 1, 2, 3)"""

DENSE = SALES + """,
days AS (SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sales),
series AS (SELECT DISTINCT store_nbr, family FROM sales),
dense AS (
  SELECT d.date, s.store_nbr, s.family, COALESCE(p.sales, 0) AS sales
  FROM days d CROSS JOIN series s
  LEFT JOIN sales p ON p.date = d.date AND p.store_nbr = s.store_nbr AND p.family = s.family)"""

STORES = "stores AS (SELECT r_regionkey AS store_nbr, r_name AS city FROM region)"

OIL = """oil AS (
  SELECT CAST(o_orderdate AS DATE) AS date, MAX(o_totalprice) AS dcoilwtico
  FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1)"""

TRANSACTIONS = """transactions AS (
  SELECT CAST(o_orderdate AS DATE) AS date, n_regionkey AS store_nbr, COUNT(*) AS transactions
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

HOLIDAY_ROWS = """holidays AS (
  SELECT make_date(y, m, d) AS date, type, description
  FROM (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem),
       (VALUES {}) AS h(m, d, type, description))""".format(
    ", ".join(f"({m}, {d}, '{t}', '{n}')" for m, d, t, n in HOLIDAYS)
)
