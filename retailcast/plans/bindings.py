"""The retail tables, derived from the order tables in a folder of parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.operators.joins import merge_sources
from retailcast.operators.panel import densify

# fixed yearly holidays: month, day, type, description
HOLIDAYS = (
    (1, 1, "Holiday", "New Year"),
    (2, 14, "Event", "Valentine"),
    (5, 1, "Holiday", "Labour Day"),
    (5, 24, "Additional Day", "Long Weekend"),
    (8, 10, "Holiday", "Founding Day"),
    (11, 2, "Holiday", "All Souls"),
    (11, 24, "Event", "Sales Friday"),
    (12, 24, "Additional Day", "Christmas Eve"),
    (12, 25, "Holiday", "Christmas"),
)
HOLIDAY_TYPES = ("Additional Day", "Event", "Holiday")


# fixed values: schemas of the order tables
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with the names of the sales table; not yet aggregated.

    The joins are left-deep: the size of each lookup is then known from its file, while
    the size of a join of lookups is a guess that can turn the broadcast around.
    """
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        table(spark, sf_dir, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("n_regionkey").alias("store_nbr"),
            F.col("p_type").alias("family"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_returnflag").alias("returnflag"),
        )
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales panel: date, store_nbr, family, sales, onpromotion."""
    promoted = F.sum(F.when(F.col("discount") >= 0.07, 1).otherwise(0)).cast("int")
    return (
        sale_lines(spark, sf_dir)
        .groupBy("date", "store_nbr", "family")
        .agg(F.sum("quantity").alias("sales"), promoted.alias("onpromotion"))
    )


def dense_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel on every day of its range, 0 where nothing was sold."""
    return densify(sales(spark, sf_dir), fill="zero", span="global")


def merged_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with promotions, store, oil price and transactions."""
    lookups = stores(spark, sf_dir), oil(spark, sf_dir), transactions(spark, sf_dir)
    return merge_sources(dense_sales(spark, sf_dir), *lookups)


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("store_nbr"), F.col("r_name").alias("city")
    )


def oil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price per working day; weekends have no row."""
    day = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf_dir, "orders")
        .where(F.weekday(day) < 5)
        .groupBy(day.alias("date"))
        .agg(F.max("o_totalprice").alias("dcoilwtico"))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("n_regionkey").alias("store_nbr"))
        .agg(F.count(F.lit(1)).alias("transactions"))
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed holidays in every year of the shipped lines."""
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).distinct()
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(t).alias("type"), F.lit(n).alias("description"))
            for m, d, t, n in HOLIDAYS
        ]
    )
    return years.where("y is not null").select("y", F.inline(rows)).select(
        F.make_date("y", "m", "d").alias("date"), "type", "description"
    )
