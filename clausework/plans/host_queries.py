"""Relational queries that the host engine answers by itself: joins, grouping sets, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inputs import table
from .registry import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by flag and status; the filter reaches the scan."""
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(*) AS orders, grouping(n_name)::BIGINT AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region and nation, with totals."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.grouping("n_name").cast("long").alias("total"))


@query("""SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000 THEN 1 ELSE 0 END AS gap FROM events)) GROUP BY 1, 2""".replace("sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id)", "CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT)"))
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user between pauses of half an hour."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("us", us).withColumn("gap", F.when(F.col("us") - F.lag("us").over(order) > 1_800_000_000, 1).otherwise(0))
    return rows.withColumn("session", F.sum("gap").over(order)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def idle_or_regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, and suppliers of a region: anti join, semi join and union."""
    t = lambda n: table(spark, sf_dir, n)
    idle = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
    near = t("supplier").join(t("nation").filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")
    return idle.union(near).distinct()


@query("""SELECT conv_id, run, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations)) GROUP BY 1, 2, 3""")
def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one role in a row, joined."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("new", F.when(F.col("role").eqNullSafe(F.lag("role").over(order)), 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("new").over(order)).groupBy("conv_id", "run", "role")
    return runs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
