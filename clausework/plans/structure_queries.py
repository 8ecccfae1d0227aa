"""Queries on document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import emit
from ..operators import structure as S
from .inputs import ORDERS, RULES, orders, pick, pick_sql, rules, table
from .registry import query


@query("""SELECT o_orderkey, o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS branch, o_orderpriority AS title, '受注' || o_custkey || 'は有効とする。' AS body,
 '第' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条' || CASE WHEN o_orderkey % 3 = 0 THEN 'の２' ELSE '' END AS number_str FROM orders""")
def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles' headings read from lines."""
    branch = F.when(F.col("o_orderkey") % 3 == 0, "の２").otherwise("")
    line = F.concat(F.lit("第"), T.wide(F.col("o_orderkey")), F.lit("条"), branch, pick(F.col("o_orderkey"), "（", "【"), "o_orderpriority", pick(F.col("o_orderkey"), "）", "】"), F.lit("　"), F.lit("受注"), F.col("o_custkey").cast("string"), F.lit("は有効とする。"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.article(line).alias("a")).select("o_orderkey", "a.number", "a.branch", "a.title", "a.body", "a.number_str")


@query(f"""SELECT l_orderkey, l_linenumber, {pick_sql('l_orderkey', 'paren_zen_num', 'num_paren', 'maru', 'num_dot', 'kanji', 'katakana')} AS kind, CAST(l_linenumber AS BIGINT) AS number, '品' || l_partkey AS body FROM lineitem""")
def marker_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, number and body of markers."""
    n = F.col("l_linenumber")
    w = T.wide(n)
    sign = F.get(F.array(F.concat(F.lit("（"), w, F.lit("）")), F.concat(w, F.lit("）")), T.format_number("decimalEnclosedCircle", n), F.concat(w, F.lit("．")), F.concat(T.kanji_numeral(n), F.lit("、")), F.concat(T.format_number("aiueoFullWidth", n), F.lit("　"))), (F.col("l_orderkey") % 6).cast("int"))
    m = T.marker(F.concat(F.lit("　"), sign, F.lit("品"), F.col("l_partkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_linenumber", "m.kind", "m.number", "m.body")


@query("SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines."""
    return S.lines(table(spark, sf_dir, "documents"))


@query(f"""SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'front' WHEN pos >= 1000000 THEN 'back' WHEN pos % 10 = 3 THEN 'dropped' ELSE 'body' END AS part FROM {RULES}""")
def body_front_back_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of its document each line is of; page numbers are dropped."""
    return S.matter(rules(spark, sf_dir)).select("doc_id", "pos", "part")


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS row_no, text FROM (
  SELECT o_custkey AS doc_id, 0 AS ord, '前付け:就業規則' AS text FROM orders GROUP BY 1
  UNION ALL SELECT o_custkey, nth * 10 + k, CASE k WHEN 0 THEN '第' || translate(CAST(nth AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条（' || o_orderpriority || '）' WHEN 1 THEN '  1:受注番号' || o_orderkey || 'は、これを有効とする。' WHEN 2 THEN '  2:次の書類を提出する。' WHEN 3 THEN '    1)申込書' ELSE '    2)誓約書' END FROM {ORDERS} o, (SELECT unnest(range(5)) AS k)
  UNION ALL SELECT o_custkey, 1000000, '後付け:附　則 / この規則は公布の日から施行する。' FROM orders GROUP BY 1)""")
def outline_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents read into trees and written as outlines."""
    return S.outlines(rules(spark, sf_dir))


@query(f"""SELECT o_custkey AS doc_id, CAST((nth - 1) * 4 + k AS INTEGER) AS unit_no, CASE k WHEN 0 THEN '第' || translate(CAST(nth AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条（' || o_orderpriority || '）　受注番号' || o_orderkey || 'は、これを有効とする。' WHEN 1 THEN '２　次の書類を提出する。' WHEN 2 THEN '（１）申込書' ELSE '（２）誓約書' END AS text,
 CASE k WHEN 0 THEN 3 ELSE 1 END::INTEGER AS n_lines, CASE WHEN k >= 2 THEN 0 END::INTEGER AS depth FROM {ORDERS} o, (SELECT unnest(range(4)) AS k)""")
def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that belong together joined into units."""
    body = S.matter(rules(spark, sf_dir)).filter("part = 'body'")
    return S.merged_units(body).select("doc_id", "unit_no", "text", "n_lines", "depth")


@query(f"""SELECT o_custkey AS doc_id, type, chapter_no, article_no, para_no, item_no FROM (SELECT o_custkey, nth FROM {ORDERS}) o, (VALUES ('article', NULL, 0, 0), ('paragraph', 1, 1, 0), ('paragraph', 2, 2, 0), ('item', 3, 2, 1), ('item', 4, 2, 2)) v(type, k, para_no, item_no), LATERAL (SELECT 0::BIGINT AS chapter_no, nth AS article_no)""".replace("para_no, item_no FROM (SELECT o_custkey", "para_no::BIGINT AS para_no, item_no::BIGINT AS item_no FROM (SELECT o_custkey"))
def tree_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of articles, paragraphs and items by windows."""
    body = S.matter(rules(spark, sf_dir)).filter("part = 'body'")
    k = F.col("pos") % 10
    kind = F.when(k == 0, "article").when((k == 1) | (k == 4), "paragraph").when(k >= 5, "item")
    return S.assign(body.withColumn("type", kind).filter("type is not null")).select("doc_id", "type", "chapter_no", "article_no", "para_no", "item_no")


@query(f"""SELECT o_custkey AS doc_id, type, number, number_str, title, body, CAST(article_no AS INTEGER) AS article_no, CAST(para_no AS INTEGER) AS para_no, CAST(item_no AS INTEGER) AS item_no FROM (
 SELECT o_custkey, 'article' AS type, nth AS number, '第' || translate(CAST(nth AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条' AS number_str, o_orderpriority AS title, NULL AS body, nth AS article_no, NULL AS para_no, NULL AS item_no FROM {ORDERS}
 UNION ALL SELECT o_custkey, 'paragraph', k, NULL, NULL, CASE k WHEN 1 THEN '受注番号' || o_orderkey || 'は、これを有効とする。' ELSE '次の書類を提出する。' END, nth, k, NULL FROM {ORDERS}, (SELECT unnest([1, 2]) AS k)
 UNION ALL SELECT o_custkey, 'item', k, NULL, NULL, ['申込書', '誓約書'][k], nth, 2, k FROM {ORDERS}, (SELECT unnest([1, 2]) AS k))""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees, nested and as JSON, laid flat again with each node's place."""
    flat = S.nodes(S.read(rules(spark, sf_dir)))
    return flat.filter(F.col("type").isin("article", "paragraph", "item")).select("doc_id", "type", "number", "number_str", "title", "body", "article_no", "para_no", "item_no")


@query(f"""SELECT o_custkey AS doc_id, 0::BIGINT AS chapters, count(*) AS articles FROM orders GROUP BY 1""")
def summary_by_article_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and articles of each document."""
    return emit.counts(S.nodes(S.read(rules(spark, sf_dir))))


@query(f"""SELECT o_custkey AS doc_id, style, count(*) AS n FROM {ORDERS}, (SELECT unnest(['03-(条見出し)', '04-第一項', '05-第二項以下', '06-(1)', '06-(1)']) AS style) GROUP BY 1, 2 UNION ALL SELECT o_custkey, 'Normal', 2 FROM orders GROUP BY 1""")
def emission_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each style in the formatted documents."""
    return emit.plan(S.nodes(S.read(rules(spark, sf_dir))), "t2").groupBy("doc_id", "style").agg(F.count("*").alias("n"))


@query(f"""SELECT o_custkey AS doc_id, 'article' AS level, '第' || translate(CAST(nth AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条（' || o_orderpriority || '）' AS text FROM {ORDERS}""")
def contents_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents."""
    return emit.contents(S.nodes(S.read(rules(spark, sf_dir)))).select("doc_id", "level", "text")


@query("""SELECT p_partkey, n AS number, CASE WHEN n = p_partkey THEN p_brand ELSE '' END AS title, body FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '削　除' ELSE '存続する。' END AS body FROM part),
 LATERAL (SELECT unnest(CASE WHEN p_partkey % 2 = 0 AND p_size > 0 THEN range(p_partkey, p_partkey + p_size + 1) ELSE [p_partkey] END) AS n)""")
def deleted_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted ranges of articles, an article each."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.col("p_partkey").alias("number"), (F.col("p_partkey") + F.col("p_size")).alias("range_to"), F.when(F.col("p_partkey") % 2 == 0, "削　除").otherwise("存続する。").alias("body"), F.col("p_brand").alias("title"))
    return S.expand_deleted(rows).select("p_partkey", "number", "title", "body")


@query(f"""SELECT o_custkey AS doc_id, pos, type, body, title FROM (
 SELECT o_custkey, nth * 10 + 1 AS pos, 'article' AS type, o_orderstatus AS body, CASE WHEN nth % 3 <> 0 THEN o_orderpriority END AS title FROM {ORDERS}
 UNION ALL SELECT o_custkey, nth * 10, 'text', o_orderpriority, NULL FROM {ORDERS} WHERE nth % 3 = 0
 UNION ALL SELECT o_custkey, nth * 10 + 2, 'text', '続き', NULL FROM {ORDERS})""".replace("nth * 10, 'text', o_orderpriority, NULL FROM", "nth * 10 - 1, 'text', o_orderpriority, NULL FROM"))
def title_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles on lines of their own go to the articles right behind them; others are text."""
    n = F.col("nth")
    each = F.array(
        F.struct((n * 10 - F.when(n % 3 == 0, 1).otherwise(0)).alias("pos"), F.lit("article_title").alias("type"), F.col("o_orderpriority").alias("body")),
        F.struct((n * 10 + 1).alias("pos"), F.lit("article").alias("type"), F.col("o_orderstatus").alias("body")),
        F.struct((n * 10 + 2).alias("pos"), F.lit("text").alias("type"), F.lit("続き").alias("body")),
        F.when(n % 3 == 0, F.struct((n * 10).alias("pos"), F.lit("table").alias("type"), F.lit("").alias("body"))),
    )
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), F.explode(F.array_compact(each)).alias("x")).select("doc_id", "x.*")
    return S.attach_titles(rows).filter("type <> 'table'")


@query(f"""SELECT o_custkey AS doc_id, nth AS pos, CASE WHEN nth % 5 <> 0 THEN {pick_sql('nth', 'maru', 'katakana', 'paren_zen_num')} END AS kind, CASE WHEN nth % 5 <> 0 THEN (nth % 5 - 1) % 3 END::INTEGER AS depth FROM {ORDERS}""")
def marker_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of markers in the nesting of their paragraph, folded in the engine."""
    n = F.col("nth")
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), n.alias("pos"), F.when(n % 5 != 0, pick(n, "maru", "katakana", "paren_zen_num")).alias("kind"), (n % 5 == 0).alias("resets"))
    return S.marker_depths(rows)


@query(f"""WITH f AS (SELECT o_custkey AS doc_id, nth AS pos, nth % 7 = 3 AS d, o_orderkey % 4 <> 0 AS l FROM {ORDERS}), w AS (SELECT *, lag(d) OVER o AS b1, lag(d, 2) OVER o AS b2, lag(d, 3) OVER o AS b3, lag(l) OVER o AS m1, lag(l, 2) OVER o AS m2, lead(d) OVER o AS f1, lead(d, 2) OVER o AS f2, lead(d, 3) OVER o AS f3, lead(l) OVER o AS n1, lead(l, 2) OVER o AS n2 FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, coalesce(d OR (l AND b1) OR (l AND m1 AND b2) OR (l AND m1 AND m2 AND b3) OR (l AND f1) OR (l AND n1 AND f2) OR (l AND n1 AND n2 AND f3), false) AS figure FROM w""")
def figure_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings and the figure-like paragraphs beside them."""
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), F.col("nth").alias("pos"), (F.col("nth") % 7 == 3).alias("drawing"), (F.col("o_orderkey") % 4 != 0).alias("figure_like"))
    return S.dilate(rows).select("doc_id", "pos", "figure")


@query(f"""WITH i AS (SELECT o_custkey AS doc_id, nth AS number, CASE WHEN o_custkey % 5 = 0 THEN 'num_dot' ELSE 'maru' END AS marker, CASE WHEN o_custkey % 7 = 0 AND nth = 2 THEN '名詞' ELSE '守ること。（注）' END AS body, CASE WHEN o_custkey % 3 = 0 THEN '柱書' ELSE ' ' END AS lead FROM {ORDERS})
SELECT doc_id, count(*) >= 2 AND bool_and(marker = 'maru' AND body LIKE '%。%') AND max(trim(lead)) = '' AS as_paragraphs FROM i GROUP BY doc_id""")
def circled_to_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose circled items stand in for paragraphs."""
    c, n = F.col("o_custkey"), F.col("nth")
    items = orders(spark, sf_dir).select(c.alias("doc_id"), n.alias("number"), F.when(c % 5 == 0, "num_dot").otherwise("maru").alias("marker"), F.when((c % 7 == 0) & (n == 2), "名詞").otherwise("守ること。（注）").alias("body"), F.when(c % 3 == 0, "柱書").otherwise(" ").alias("paragraph_body"), F.lit(1).alias("n_paragraphs"), F.lit(0).alias("figures"))
    return S.circled_paragraphs(items, ["doc_id"])


@query(f"""SELECT o_custkey AS doc_id, CAST(nth AS BIGINT) AS old_number, row_number() OVER (PARTITION BY o_custkey ORDER BY ord) AS number FROM (SELECT o_custkey, nth, nth * 2 AS ord FROM {ORDERS} UNION ALL SELECT o_custkey, NULL, nth * 2 + 1 FROM {ORDERS} WHERE nth % 3 = 0)""")
def renumber_after_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by place once articles were inserted."""
    o = orders(spark, sf_dir)
    old = o.select(F.col("o_custkey").alias("doc_id"), F.col("nth").alias("old_number"), (F.col("nth") * 2).alias("ord"))
    new = o.filter("nth % 3 = 0").select(F.col("o_custkey").alias("doc_id"), F.lit(None).cast("long").alias("old_number"), (F.col("nth") * 2 + 1).alias("ord"))
    return S.renumber(old.unionByName(new)).select("doc_id", "old_number", "number")


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|h2|h3|li)[^>]*>[^<]*')) AS tag, generate_subscripts(regexp_extract_all(html, '<(?:h1|h2|h3|li)[^>]*>[^<]*'), 1) AS pos FROM pages)
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, regexp_extract(tag, '<(h1|h2|h3|li)', 1) AS level, regexp_extract(tag, '>([^<]*)', 1) AS text, count(*) FILTER (WHERE tag LIKE '<h%') OVER (PARTITION BY page_id ORDER BY pos) AS heading_no FROM t""")
def html_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and list items of web pages, each with the heading it is under."""
    tags = F.regexp_extract_all("html", F.lit("(<(?:h1|h2|h3|li)[^>]*>[^<]*)"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    under = F.count_if(F.col("tag").startswith("<h")).over(Window.partitionBy("page_id").orderBy("pos"))
    return rows.select("page_id", "pos", F.regexp_extract("tag", "<(h1|h2|h3|li)", 1).alias("level"), F.regexp_extract("tag", ">([^<]*)", 1).alias("text"), under.alias("heading_no"))


@query(f"""SELECT o_orderkey, {pick_sql('o_orderkey', '予告文があるが下位項目なし', '予告文あり（下位の分割漏れ確認）', '長文＋分割痕跡')} AS reason FROM orders WHERE o_orderkey % 4 <> 3 OR o_orderkey % 3 <> 2""")
def suspicious_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that may hold items run into their text."""
    k = F.col("o_orderkey")
    long_text = F.concat(F.lit("従業員は、"), F.repeat(F.lit("職務に専念し"), 20), F.when(k % 4 == 3, "。").otherwise("①誠実に行うこと。②守ること。"))
    body = F.get(F.array(F.lit("次の各号のいずれかに該当する。"), F.lit("以下の書類を提出する。"), long_text), (k % 3).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), F.when(k % 3 == 1, 1).otherwise(0).alias("n_below"), F.lit(0).alias("n_tables"))
    return S.suspicious(rows).select("o_orderkey", "reason")


@query(f"""SELECT o_custkey AS doc_id, k * 100000 + nth * 10 AS pos, k = 0 AND o_custkey % 3 < 2 AS toc FROM {ORDERS}, (SELECT unnest([0, 1]) AS k) WHERE o_custkey % 3 < 2 OR k = 1
UNION ALL SELECT o_custkey, 0, o_custkey % 3 = 1 FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1""".replace("o_custkey % 3 < 2 OR k = 1", "o_custkey % 3 <> 2 OR k = 1").replace("k = 0 AND o_custkey % 3 < 2 AS toc", "k = 0 AS toc"))
def manual_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of typed tables of contents: with page numbers, with a title and without numbers, and a title that nothing follows."""
    o, n, c = orders(spark, sf_dir), F.col("nth"), F.col("o_custkey")
    heading = F.concat(F.lit("第"), n.cast("string"), F.lit("条（"), F.col("o_orderpriority"), F.lit("）"))
    listed = o.filter("o_custkey % 3 <> 2").select(c.alias("doc_id"), (n * 10).alias("pos"), F.when(c % 3 == 0, F.concat(heading, F.lit(" …… "), n.cast("string"))).otherwise(heading).alias("line"))
    body = o.select(c.alias("doc_id"), (F.lit(100_000) + n * 10).alias("pos"), F.concat(heading, F.lit("　有効とする。")).alias("line"))
    title = o.filter("o_custkey % 3 > 0").select(c.alias("doc_id"), F.lit(0).cast("long").alias("pos"), F.lit("目　次").alias("line")).distinct()
    return S.contents_lines(listed.unionByName(body).unionByName(title)).select("doc_id", "pos", "toc")


@query(f"""SELECT o_orderkey, ord::INTEGER AS ord, piece, marked FROM (SELECT o_orderkey, unnest([{{'ord': 0, 'piece': '甲', 'marked': false}}, {{'ord': 1, 'piece': '及び', 'marked': true}}, {{'ord': 2, 'piece': '乙' || o_custkey, 'marked': false}}], recursive := true) FROM orders)""")
def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut where spans that are to be marked begin and end."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("甲及び乙"), F.col("o_custkey").cast("string")).alias("text"))
    marked = rows.select("o_orderkey", F.lit(1).alias("start"), F.lit(3).alias("end"))
    return emit.segments(rows, marked, ["o_orderkey"])
