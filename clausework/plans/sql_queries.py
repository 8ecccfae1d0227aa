"""Queries written in SQL over the functions that the library registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.register import register
from .inputs import table
from .registry import query


def _session(spark: SparkSession, sf_dir: str, name: str) -> SparkSession:
    """spark with the library's functions and a table as the view cw_rows."""
    register(spark)
    table(spark, sf_dir, name).createOrReplaceTempView("cw_rows")
    return spark


_WIDE = "translate(CAST({n} AS VARCHAR), '0123456789', '０１２３４５６７８９')"


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 99 + 1 AS BIGINT) AS n FROM part)
SELECT p_partkey, CASE WHEN n >= 20 THEN substr('〇一二三四五六七八九', n // 10 + 1, 1) ELSE '' END || CASE WHEN n >= 10 THEN '十' ELSE '' END || CASE WHEN n % 10 > 0 THEN substr('〇一二三四五六七八九', n % 10 + 1, 1) ELSE '' END AS kanji,
 n AS back, {_WIDE.format(n="n")} AS wide, n + 1 AS article, ['chapter', 'article', 'blank'][p_partkey % 3 + 1] AS kind, 'paren_zen_num' AS marker, n AS marked, 3 AS indent, '1件' AS safe FROM p""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals, headings and marks by SQL functions, which Catalyst puts in place."""
    return _session(spark, sf_dir, "part").sql("""
        WITH p AS (SELECT p_partkey, p_partkey % 99 + 1 AS n FROM cw_rows)
        SELECT p_partkey, cw_kanji_numeral(n) AS kanji, cw_number(cw_kanji_numeral(n)) AS back, cw_same_script(n, '１') AS wide, cw_article(concat('第', cw_wide(n + 1), '条（目的）')).number AS article,
          cw_kind(element_at(array('第１章　総則', '第１条（目的）', '　'), CAST(p_partkey % 3 + 1 AS INT))) AS kind, cw_marker(concat('（', n, '）申込書')).kind AS marker, cw_marker(concat('（', n, '）申込書')).number AS marked,
          cw_indent_width('　 申込書') AS indent, cw_safe_name('1件') AS safe FROM p""")


@query("""SELECT o_orderkey AS doc_id, k - 1 AS ref_no, ['第' || o_custkey || '条', '第２条'][k] AS ref, [o_custkey, 2][k] AS article, k = 2 AS external FROM orders, (SELECT unnest([1, 2])::INTEGER AS k)""")
def sql_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References found by a table function over a partitioned table."""
    return _session(spark, sf_dir, "orders").sql("""
        SELECT doc_id, ref_no, ref, article, external FROM cw_reference_rows(TABLE(SELECT o_orderkey AS doc_id, concat('甲は第', o_custkey, '条に、乙は民法第２条による。') AS body FROM cw_rows) PARTITION BY doc_id)""")


@query("""SELECT p_partkey AS doc_id, k - 1 AS row_no, ['第１条（甲' || p_partkey || '）', '  1:一。', '  2:二。'][k] AS text FROM part, (SELECT unnest([1, 2, 3])::INTEGER AS k)""")
def sql_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines by a table function over lines that SQL partitions and orders."""
    return _session(spark, sf_dir, "part").sql("""
        SELECT doc_id, row_no, text FROM cw_outline_rows(TABLE(SELECT p_partkey AS doc_id, pos, line FROM cw_rows LATERAL VIEW posexplode(array(concat('第１条（甲', p_partkey, '）'), '一。', '２　二。')) AS pos, line) PARTITION BY doc_id ORDER BY pos)""")
