"""Queries on tables and drawings, and on references that are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attach, notes
from ..operators import refs as R
from .inputs import ITEMS, ORDERS, items, orders, pick, table
from .registry import query

_KINDS = ["chapter", "article", "paragraph", "table", "item", "drawing", "article", "table", "sub", "paragraph", "sub2", "text", "drawing"]
_BLOCKS = f"(SELECT l_orderkey // 16 AS doc_id, l_orderkey * 8 + l_linenumber AS pos, {_KINDS}[l_partkey % 13 + 1] AS kind, l_partkey FROM {ITEMS})"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(F.floor(F.col("l_orderkey") / 16).alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), pick(F.col("l_partkey"), *_KINDS).alias("kind"), "l_partkey")


@query(f"""WITH b AS {_BLOCKS}, h AS (SELECT doc_id, pos, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) - 1 AS index FROM b WHERE kind IN ('table', 'drawing')),
n AS (SELECT * FROM b WHERE kind NOT IN ('table', 'drawing', 'text'))
SELECT h.doc_id, h.pos, h.kind, h.index, CASE n.kind WHEN 'article' THEN 'paragraph' ELSE coalesce(n.kind, 'front') END AS holder, n.pos AS held_at, coalesce(n.kind = 'article', false) AS made FROM h ASOF LEFT JOIN n ON n.doc_id = h.doc_id AND n.pos <= h.pos""")
def table_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node on which every table and drawing hangs: before, in and behind items, in articles without paragraphs, in front matter."""
    return attach.attached(_blocks(spark, sf_dir)).withColumnRenamed("at", "held_at")


@query(f"""WITH b AS {_BLOCKS}, n AS (SELECT * FROM b WHERE kind NOT IN ('table', 'drawing', 'text')), h AS (SELECT h.doc_id, h.pos, h.kind, 'x' || h.l_partkey AS content, n.pos AS held_at, n.kind = 'article' AS made FROM (SELECT * FROM b WHERE kind IN ('table', 'drawing')) h ASOF JOIN n ON n.doc_id = h.doc_id AND n.pos <= h.pos),
g AS (SELECT doc_id, held_at, made, coalesce(string_agg(content, '+' ORDER BY pos) FILTER (WHERE kind = 'table'), '') AS tables, coalesce(string_agg(content, '+' ORDER BY pos) FILTER (WHERE kind = 'drawing'), '') AS drawings FROM h GROUP BY ALL)
SELECT n.doc_id, n.pos, n.kind, coalesce(g.tables, '') AS tables, coalesce(g.drawings, '') AS drawings FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.held_at = n.pos AND NOT g.made UNION ALL SELECT doc_id, held_at, 'paragraph', tables, drawings FROM g WHERE made""")
def nodes_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes with the contents of their tables and drawings, and the paragraphs that were made to hold some."""
    blocks = _blocks(spark, sf_dir)
    contents = blocks.select("doc_id", "pos", F.concat(F.lit("x"), F.col("l_partkey").cast("string")).alias("content"))
    out = attach.hung(blocks.filter(F.col("kind").isin(*attach.NODES)).select("doc_id", "pos", "kind"), attach.attached(blocks), contents)
    return out.select("doc_id", "pos", "kind", F.array_join("tables", "+").alias("tables"), F.array_join("drawings", "+").alias("drawings"))


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey % 4 AS article, o_orderkey % 7 AS paragraph, o_orderkey FROM orders), n AS (SELECT doc_id, article, count(*) AS n FROM o WHERE o_orderkey % 3 = 1 GROUP BY ALL)
SELECT doc_id, article, paragraph, o_orderkey, CASE WHEN n > 0 THEN least(paragraph, n - 1) END AS new_paragraph FROM o LEFT JOIN n USING (doc_id, article) WHERE o_orderkey % 2 = 0""")
def table_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables put back on an article's new paragraphs, of which there may be fewer or none."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (key % 4).alias("article"), (key % 7).alias("paragraph"), "o_orderkey")
    return attach.restored(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 1"), ["doc_id", "article"]).withColumnRenamed("to", "new_paragraph")


_KANJI = "(CASE WHEN {n} >= 20 THEN substr('〇一二三四五六七八九', {n} // 10 + 1, 1) ELSE '' END || CASE WHEN {n} >= 10 THEN '十' ELSE '' END || CASE WHEN {n} % 10 > 0 THEN substr('〇一二三四五六七八九', {n} % 10 + 1, 1) ELSE '' END)"
_WIDE = "translate(CAST({n} AS VARCHAR), '0123456789', '０１２３４５６７８９')"


@query(f"""SELECT o_custkey AS doc_id, nth, '新しい第' || {_WIDE.format(n="(CAST(nth AS BIGINT) + 1)")} || '条、第' || {_KANJI.format(n="(CAST(nth AS BIGINT) + 1)")} || '条第２項、第' || (nth + 1) || '条及び第' || (nth + 900) || '条［参照先なし］による。民法第' || nth || '条及び第' || nth || '条。' AS rewritten, '第' || (nth + 900) || '条' AS missing FROM {ORDERS}""")
def ref_rewrite_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in full-width, kanji and half-width numerals once an article was put in front, one to an article that isn't there, and a law's own."""
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "doc_id")
    n = F.col("nth")
    articles = o.select("doc_id", n.alias("ord"), n.alias("rid"), n.alias("number"), F.lit(0).cast("long").alias("branch"))
    text = n.cast("string")
    body = F.concat(F.lit("新しい第"), T.wide(n), F.lit("条、第"), T.kanji_numeral(n), F.lit("条第２項、第"), text, F.lit("条及び第"), (n + 900).cast("string"), F.lit("条による。民法第"), text, F.lit("条及び第"), text, F.lit("条。"))
    out = R.rewrite(o.select("doc_id", "nth", body.alias("body")), R.keys(articles), o.select("doc_id", n.alias("rid"), (n + 1).alias("number")))
    return out.select("doc_id", "nth", "rewritten", F.array_join("missing", "+").alias("missing"))


_SPANS = f"(SELECT l_orderkey AS doc_id, l_linenumber AS pos, CAST(l_suppkey % 7 AS INTEGER) AS start, CAST(l_suppkey % 7 + 1 + l_partkey % 6 AS INTEGER) AS stop, l_partkey % 3 AS grp, 's' || l_partkey AS surface FROM {ITEMS})"


@query(f"""WITH s AS (SELECT * REPLACE (least(stop, 10) AS stop) FROM {_SPANS}), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos, start, stop, surface) = 1),
c AS (SELECT DISTINCT doc_id, pos, unnest([0, 4, 10, start, stop]) AS edge FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY edge) - 1 AS piece FROM c)
SELECT row_number() OVER (ORDER BY f.doc_id, f.pos, f.start, f.grp) - 1 AS comment_id, f.doc_id, f.pos, f.grp, f.surface, CAST(a.piece AS INTEGER) AS from_piece, CAST(b.piece - 1 AS INTEGER) AS to_piece
FROM f JOIN p a ON a.doc_id = f.doc_id AND a.pos = f.pos AND a.edge = f.start JOIN p b ON b.doc_id = f.doc_id AND b.pos = f.pos AND b.edge = f.stop""")
def comment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments at the first finding of each group in each order's text, numbered over all orders, between the pieces where they begin and end."""
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 7).cast("int").alias("start"), (F.col("l_suppkey") % 7 + 1 + F.col("l_partkey") % 6).cast("int").alias("end"), (F.col("l_partkey") % 3).alias("group"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("surface"))
    runs = rows.select("doc_id", "pos", F.posexplode(F.array(F.lit("abcd"), F.lit("efghij"))).alias("run", "text"))
    return notes.ranges(rows, runs).withColumnRenamed("group", "grp")


@query("""SELECT p_partkey AS doc_id, '<w:comments xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">' || string_agg('<w:comment w:id="' || k || '" w:author="整形ツール" w:date="2000-01-01T00:00:00Z" w:initials="整形"><w:p>' || '<w:r><w:t xml:space="preserve">' || replace(CASE k
 WHEN 0 THEN '【表記ゆれ】この語は文書内で表記がゆれています。' || chr(10) || '・「取扱い」… 他に「取扱」「取り扱い」（取扱 ' || p_size || '件／取扱い 2件／取り扱い 1件）' || chr(10) || '※ 送り仮名は名詞用法だけを対象にしています（「申し出る」などの動詞は除外）。' || chr(10) || '※ このコメントはゆれ1件につき初出の1箇所だけに付けています。該当箇所は文書全体で青字にしています（自動修正なし）。'
 ELSE CASE WHEN p_size % 2 = 0 THEN '【用語の誤用】' ELSE '【用語の確認】' END || '「規程&amp;」は「規定」' || CASE WHEN p_size % 2 = 0 THEN 'の誤りと思われます。' ELSE 'が適切かもしれません。' END || chr(10) || '※ 自動修正はしていません。ご確認ください。' END, chr(10), '</w:t></w:r><w:r><w:br/></w:r><w:r><w:t xml:space="preserve">') || '</w:t></w:r></w:p></w:comment>', '' ORDER BY k) || '</w:comments>' AS xml FROM part, (SELECT unnest([0, 1]) AS k) GROUP BY p_partkey""")
def comments_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a file that holds its comments: one on spellings, one on a misused word."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("long").alias("size"))
    form = lambda f, n: F.struct(F.lit(f).alias("form"), n.cast("long").alias("n"))
    said = F.array(
        F.struct(F.lit(0).alias("nth"), F.lit("取扱い").alias("surface"), F.lit("送り仮名").alias("category"), F.array(form("取扱", F.col("size")), form("取扱い", F.lit(2)), form("取り扱い", F.lit(1)), form("取扱ひ", F.lit(0))).alias("counts"), F.lit(None).cast("string").alias("correct")),
        F.struct(F.lit(1).alias("nth"), F.lit("規程&").alias("surface"), F.lit("用語の誤用").alias("category"), F.array(form("規程", F.lit(1))).alias("counts"), F.lit("規定").alias("correct")),
    )
    rows = p.select("doc_id", "size", F.explode(said).alias("c")).select("doc_id", "size", "c.*")
    return notes.part(rows.select("doc_id", "nth", notes.text(F.col("surface"), F.col("category"), F.col("counts"), F.col("correct"), F.col("size") % 2 == 0).alias("text")))
