"""Tables, and the document text that queries build from their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(n: Column, *values: str) -> Column:
    """The value at n modulo their number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nth, their place among their customer's."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(own).cast("long"))


#: The same in SQL.
ORDERS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)"


def items(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Line items, one for each number of an order; together: dealt out by order, so that steps by order need no other shuffle."""
    columns = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem")
    return (rows.repartition("l_orderkey") if together else rows).groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in columns))


#: The same in SQL.
ITEMS = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)"


def pick_sql(n: str, *values: str) -> str:
    quoted = ", ".join("'" + v + "'" for v in values)
    return f"[{quoted}][CAST({n} AS BIGINT) % {len(values)} + 1]"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line: each customer's orders as a document: a cover, a title on a line of its own, an article of two paragraphs and an item for each order, a page number now and then, supplementary provisions."""
    o = orders(spark, sf_dir)
    n = F.col("nth")
    parts = [
        (F.lit(0), F.concat(F.lit("第"), T.wide(n), F.lit("条（"), F.col("o_orderpriority"), F.lit("）"))),
        (F.lit(1), F.concat(F.lit("　受注番号"), F.col("o_orderkey").cast("string"), F.lit("は、"))),
        (F.lit(2), F.lit("これを有効とする。")),
        (F.lit(3), F.when(n % 4 == 0, F.concat(F.lit("－ "), T.wide(n), F.lit(" －")))),
        (F.lit(4), F.lit("２　次の書類を提出する。")),
        (F.lit(5), F.lit("（１）申込書")),
        (F.lit(6), F.lit("（２）誓約書")),
    ]
    body = o.select(F.col("o_custkey").alias("doc_id"), F.explode(F.array(*(F.struct((n * 10 + k).alias("pos"), x.alias("line")) for k, x in parts))).alias("p")).select("doc_id", "p.*").filter("line is not null")
    ends = o.select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("就業規則").alias("line")), F.struct(F.lit(1_000_000).cast("long").alias("pos"), F.lit("附　則").alias("line")), F.struct(F.lit(1_000_001).cast("long").alias("pos"), F.lit("この規則は公布の日から施行する。").alias("line")))).alias("p")).select("doc_id", "p.*")
    return body.unionByName(ends)


#: rules() in SQL.
RULES = f"""(
  SELECT o_custkey AS doc_id, nth * 10 + k AS pos, CASE k WHEN 0 THEN '第' || translate(CAST(nth AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条（' || o_orderpriority || '）'
    WHEN 1 THEN '　受注番号' || o_orderkey || 'は、' WHEN 2 THEN 'これを有効とする。' WHEN 3 THEN '－ ' || translate(CAST(nth AS VARCHAR), '0123456789', '０１２３４５６７８９') || ' －'
    WHEN 4 THEN '２　次の書類を提出する。' WHEN 5 THEN '（１）申込書' ELSE '（２）誓約書' END AS line
  FROM {ORDERS} o, (SELECT unnest(range(7)) AS k) WHERE k <> 3 OR nth % 4 = 0
  UNION ALL
  SELECT doc_id, [0, 1000000, 1000001][k] AS pos, ['就業規則', '附　則', 'この規則は公布の日から施行する。'][k] AS line FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders), (SELECT unnest([1, 2, 3]) AS k)
)"""
