"""Relational reports over the order tables: grouped aggregates, joins, windows, anti joins.

Money sums go through DECIMAL, so that the order in which partitions merge cannot change a digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.sources import table


def _money(c):
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by return flag and line status: one scan of five columns, one map-side-combined exchange."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        _money(price).alias("sum_base_price"),
        _money(F.round(price * (1 - disc), 4)).alias("sum_disc_price"),
        F.count("*").alias("count_order"),
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per customer nation: orders and lines meet on the order key, AQE splits skewed keys."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, F.col("o_custkey") == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .groupBy("n_name")
        .agg(_money(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).alias("revenue"), F.count("*").alias("n_lines"))
    )


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line refers to."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_anti")


def events_per_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and day with a running count: the window sorts daily sums, not raw events."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("user_id", F.col("day").cast("string").alias("day"), "n", F.sum("n").over(w).alias("running"))


QUERIES = {
    "pricing_summary": pricing_summary,
    "revenue_by_nation": revenue_by_nation,
    "orders_without_lines": orders_without_lines,
    "events_per_user_day": events_per_user_day,
}

SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_base_price,
               CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc_price,
               count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "revenue_by_nation": """
        SELECT n_name, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
               count(*) AS n_lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "orders_without_lines": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "events_per_user_day": """
        SELECT user_id, CAST(day AS VARCHAR) AS day, n,
               CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS running
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)""",
}
