"""Queries on verification and on versions side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..operators import answers, crossref, settings
from ..operators import compare as C
from ..operators import structure as S
from ..operators import validate
from ..operators import verify as V
from .inputs import ORDERS, orders, pick, pick_sql, table
from .registry import query

_LINES = """(SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, regexp_replace(line, '\\s', '', 'g') AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_replace(line, '\\s', '', 'g') <> '')"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines without blanks, numbered as they stand."""
    rows = S.lines(table(spark, sf_dir, "documents")).withColumn("norm", F.regexp_replace("line", "\\s", ""))
    return rows.filter("norm <> ''").select("doc_id", "pos", "norm")


@query(f"""WITH l AS {_LINES}, o AS (SELECT * FROM l WHERE pos % 5 <> 3), w AS (SELECT doc_id, string_agg(norm, '' ORDER BY pos, norm) AS whole FROM o GROUP BY 1)
SELECT doc_id, pos, norm FROM l LEFT JOIN w USING (doc_id) WHERE NOT coalesce(contains(whole, norm), false)""")
def verify_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an output without every fifth of them has nowhere."""
    src = _lines(spark, sf_dir)
    return V.absent(src, src.filter("pos % 5 <> 3"))


@query(f"""WITH l AS {_LINES}, s AS (SELECT doc_id, norm FROM l GROUP BY ALL), c AS (SELECT doc_id, norm, count(*) AS n_out FROM l WHERE len(norm) >= 8 GROUP BY ALL) SELECT doc_id, norm, 1::BIGINT AS n_src, n_out FROM c WHERE n_out > 1""")
def verify_duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that come more often than in a source that has each once."""
    out = _lines(spark, sf_dir)
    return V.repeated(out.dropDuplicates(["doc_id", "norm"]), out)


@query(f"""WITH l AS {_LINES} SELECT coalesce(s.doc_id, o.doc_id) AS doc_id, coalesce(src_paragraphs, 0) AS src_paragraphs, coalesce(src_chars, 0)::BIGINT AS src_chars, coalesce(out_paragraphs, 0) AS out_paragraphs, coalesce(out_chars, 0)::BIGINT AS out_chars
FROM (SELECT doc_id, count(*) AS src_paragraphs, sum(len(norm)) AS src_chars FROM l GROUP BY 1) s FULL JOIN (SELECT doc_id, count(*) AS out_paragraphs, sum(len(norm)) AS out_chars FROM l WHERE pos % 5 <> 3 GROUP BY 1) o USING (doc_id)""")
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and characters of source and output."""
    src = _lines(spark, sf_dir)
    return V.totals(src, src.filter("pos % 5 <> 3"))


@query(f"""SELECT o_custkey AS doc_id, nth, o_orderkey % 3 = 0 AS by_edit FROM {ORDERS} WHERE o_orderkey % 3 < 2""")
def verify_edited_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing sentences told apart: those that editing took away, and those that were lost."""
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "doc_id")
    norm = F.concat(F.lit("受注番号"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("を処理する"))
    rows = o.select("doc_id", "nth", "o_orderkey", norm.alias("norm"))
    return V.attributed(rows.filter("o_orderkey % 3 < 2"), rows, rows.filter("o_orderkey % 3 > 0")).select("doc_id", "nth", "by_edit")


@query(f"""WITH l AS {_LINES}, d AS (SELECT doc_id, norm FROM l WHERE len(norm) >= 8 GROUP BY ALL HAVING count(*) > 1), g AS (SELECT doc_id, list(norm ORDER BY norm) AS t FROM d GROUP BY 1)
SELECT doc_id, '## 重複（' || len(t) || '件）' || chr(10) || array_to_string(list_transform(t[1:5], lambda x: '- ' || x), chr(10)) || CASE WHEN len(t) > 5 THEN chr(10) || '- …他' || (len(t) - 5) || '件' ELSE '' END AS report FROM g""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on repeated lines."""
    found = verify_duplicated(spark, sf_dir).select("doc_id", F.lit("重複").alias("section"), F.col("norm").alias("ord"), F.col("norm").alias("text"))
    return V.report(found)


_SIDES = f"""o AS (SELECT o_custkey AS doc_id, '題' || o_orderkey AS title, nth AS old_number, '本文' || o_orderkey AS old_body FROM {ORDERS}), n AS (
 SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS new_number, body AS new_body FROM (
  SELECT o_custkey AS doc_id, '題' || o_orderkey AS title, nth * 2 AS ord, CASE WHEN o_orderkey % 5 = 0 THEN '改正' ELSE '' END || '本文' || o_orderkey AS body FROM {ORDERS} WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_custkey, '新' || o_orderkey, nth * 2 + 1, '新設' FROM {ORDERS} WHERE o_orderkey % 11 = 0)), k AS (
 SELECT doc_id, title, old_number, new_number, CASE WHEN old_number IS NULL THEN 'added' WHEN new_number IS NULL THEN 'deleted' WHEN old_body <> new_body THEN 'changed' WHEN old_number <> new_number THEN 'renumbered' ELSE 'same' END AS kind FROM o FULL JOIN n USING (doc_id, title))"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "doc_id")
    key, n = F.col("o_orderkey"), F.col("nth")
    old = o.select("doc_id", F.concat(F.lit("題"), key.cast("string")).alias("title"), n.alias("number"), F.concat(F.lit("本文"), key.cast("string")).alias("body"))
    kept = o.filter("o_orderkey % 7 <> 0").select("doc_id", F.concat(F.lit("題"), key.cast("string")).alias("title"), (n * 2).alias("ord"), F.concat(F.when(key % 5 == 0, "改正").otherwise(""), F.lit("本文"), key.cast("string")).alias("body"))
    new = o.filter("o_orderkey % 11 = 0").select("doc_id", F.concat(F.lit("新"), key.cast("string")).alias("title"), (n * 2 + 1).alias("ord"), F.lit("新設").alias("body"))
    return C.kinds(old, S.renumber(kept.unionByName(new)))


@query(f"WITH {_SIDES} SELECT doc_id, title, old_number, new_number, kind FROM k")
def compare_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of change of each article, by joins."""
    return _kinds(spark, sf_dir).select("doc_id", "title", "old_number", "new_number", "kind")


@query(f"""WITH {_SIDES}, b AS (SELECT *, coalesce(new_number, old_number) * 1000 + coalesce(old_number, 0) AS ord FROM k), i AS (SELECT *, sum(CASE WHEN kind <> 'renumbered' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM b), r AS (
 SELECT *, row_number() OVER (PARTITION BY doc_id, island, kind ORDER BY ord) AS nth, count(*) OVER (PARTITION BY doc_id, island, kind) AS size FROM i WHERE kind <> 'same'), f AS (SELECT *, kind = 'renumbered' AND nth > 2 AND size >= 4 AS summed FROM r)
SELECT doc_id, ord, kind, old_number, new_number, 1::BIGINT AS n, '' AS shift FROM f WHERE NOT summed UNION ALL
SELECT doc_id, min(ord), 'summary', min(old_number), min(new_number), count(*), CASE WHEN bool_and(new_number > old_number) THEN 'down' WHEN bool_and(new_number < old_number) THEN 'up' ELSE 'mixed' END FROM f WHERE summed GROUP BY doc_id, island""")
def compare_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed articles, long runs of mere renumbering summed up."""
    place = F.coalesce("new_number", "old_number") * 1000 + F.coalesce("old_number", F.lit(0))
    return C.summarize_runs(_kinds(spark, sf_dir).withColumn("ord", place))


@query(f"""WITH d AS (SELECT o_custkey AS doc_id, count(*) AS n FROM {ORDERS} GROUP BY 1)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS ord, CASE k WHEN 1 THEN 'changed' ELSE 'added' END AS kind, CASE k WHEN 1 THEN '第１条（題１）' ELSE '' END AS old_heading, CASE k WHEN 1 THEN '第１条（題１）' ELSE '第' || translate(CAST(n + 1 AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条（雑則）' END AS new_heading FROM d, (SELECT unnest([1, 2]) AS k)""")
def compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of all articles aligned, with the rows of their comparison: the first article reworded, one more at the end."""
    n = F.col("nth").cast("string")
    wide = F.translate(n, "0123456789", "０１２３４５６７８９")
    text = lambda body: F.concat(F.lit('{"type":"article","number":'), n, F.lit(',"number_str":"第'), wide, F.lit('条","title":"題'), wide, F.lit('","paragraphs":[{"type":"paragraph","number":1,"body":"'), body, F.lit('","items":[]}]}'))
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), "nth", text(F.concat(F.lit("会社は受注"), F.col("o_orderkey").cast("string"), F.lit("を有効とする。"))).alias("old"), text(F.concat(F.lit("会社は受注"), F.col("o_orderkey").cast("string"), F.when(F.col("nth") == 1, "を速やかに有効とする。").otherwise("を有効とする。"))).alias("new"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", c))), lambda x: x[c]), ",")
    more = ',{"type":"article","number":0,"number_str":"","title":"雑則","paragraphs":[{"type":"paragraph","number":1,"body":"別に定めるところによるものとし、詳細は通知する。","items":[]}]}'
    versions = o.groupBy("doc_id").agg(F.concat(F.lit("["), joined("old"), F.lit("]")).alias("old"), F.concat(F.lit("["), joined("new"), F.lit(more + "]")).alias("new"))
    return C.rows(versions).select("doc_id", "ord", "kind", "old_heading", "new_heading")


@query(f"""SELECT p_partkey AS doc_id, {pick_sql('p_partkey', '[0]', '[0]/paragraphs[0]', '[0]', '[0]/tables[0]', '')} AS path, {pick_sql('p_partkey', 'number', 'body', 'title', 'table_shape', 'json')} AS rule FROM part WHERE p_partkey % 6 <> 5""".replace("% 5 + 1]", "% 6 + 1]"))
def validate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that trees break; every sixth breaks none."""
    one = lambda s: '[{"type":"article",' + s + "}]"
    bad = ['"number":true,"paragraphs":[]', '"number":1,"paragraphs":[{"body":3}]', '"number":1,"title":5,"paragraphs":[]', '"number":1,"tables":[{"rows":[]}],"paragraphs":[]']
    trees = [*map(one, bad), "{", one('"number":1,"title":"目的","paragraphs":[{"body":"本文","items":[]}]')]
    return validate.violations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pick(F.col("p_partkey"), *trees).alias("tree")))


@query(f"""SELECT o_custkey AS doc_id, o_orderpriority AS style FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(nth)) AS k FROM {ORDERS} GROUP BY 1, 2) WHERE k = 1""")
def most_common_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that each document uses most, of equals the first."""
    return settings.most_common(orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), F.col("nth").alias("pos"), F.col("o_orderpriority").alias("style")), ["doc_id"], "style")


@query("""SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 4 = 2 THEN 't3' ELSE ['t1', 't2', 't2', 't4'][o_custkey % 4 + 1] END AS template FROM orders GROUP BY 1""")
def template_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template that each document's styles are of."""
    from ..operators.emit import STYLES

    names = ["t1", "t2", "t3", "t4"]
    styles = F.get(F.array(*(F.array(*map(F.lit, STYLES[t])) for t in names)), (F.col("o_custkey") % 4).cast("int"))
    docs = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    rows = docs.select(F.col("o_custkey").alias("doc_id"), F.explode(styles).alias("style"), F.when(F.col("o_custkey") % 4 == 2, "　本文").otherwise("本文").alias("text"))
    return settings.detect_template(rows)


@query(f"""SELECT o_custkey AS doc_id, nth AS pos, CASE WHEN nth % 3 = 2 THEN nth - 1 ELSE nth END AS "at" FROM {ORDERS}""")
def bookmark_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph that bears an article's number: each article has a numbered heading and two paragraphs, the second of which stays."""
    n = F.col("nth")
    heading = n % 3 == 1
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), n.alias("pos"), F.when(heading, 1).otherwise(2).alias("level"), F.when(heading, F.concat(F.lit("第"), n.cast("string"), F.lit("条"))).otherwise(n.cast("string")).alias("label"))
    return crossref.numbered_neighbour(rows).select("doc_id", "pos", "at")


@query(f"""SELECT o_custkey AS doc_id, nth AS pos, CASE WHEN nth % 4 <> 0 THEN nth * 2 END AS found FROM {ORDERS}""")
def paragraph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where source paragraphs are in an output that lost every fourth and put numbers before the others."""
    o, n = orders(spark, sf_dir), F.col("nth")
    text = F.concat(F.lit("受注番号 "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(" を処理する。"))
    src = o.select(F.col("o_custkey").alias("doc_id"), n.alias("pos"), text.alias("text"))
    out = o.filter("nth % 4 <> 0").select(F.col("o_custkey").alias("doc_id"), (n * 2).alias("pos"), F.concat(pick(n, "", "２　"), text).alias("text"))
    return crossref.find(src, out).select("doc_id", "pos", "found")


@query("""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, CAST(pos - 1 AS INTEGER) AS pos, len(CAST(pos - 1 AS VARCHAR) || ': ' || line) + 1 AS n, line LIKE '%.' AND (pos - 1) % 6 = 2 AS target FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
 c AS (SELECT doc_id, k, pos, target, 0 AS chunk, n AS filled FROM l WHERE k = 1 UNION ALL SELECT l.doc_id, l.k, l.pos, l.target, c.chunk + CASE WHEN c.filled > 0 AND c.filled + l.n > 2000 THEN 1 ELSE 0 END, CASE WHEN c.filled > 0 AND c.filled + l.n > 2000 THEN l.n ELSE c.filled + l.n END FROM c JOIN l ON l.doc_id = c.doc_id AND l.k = c.k + 1)
SELECT doc_id, pos, chunk::INTEGER AS chunk FROM c WHERE (doc_id, chunk) IN (SELECT (doc_id, chunk) FROM c WHERE target)""")
def prompt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put into chunks of a bounded size; those without a line to be judged are left out."""
    rows = S.lines(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("target", F.col("line").endswith(".") & (F.col("pos") % 6 == 2))
    return answers.chunks(rows, chars=2000).select("doc_id", "pos", "chunk")


@query("""SELECT o_custkey AS doc_id, o_orderkey // 3 * 10 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS pos, '第' || o_orderkey || '条　番号' || o_orderkey AS hint FROM orders WHERE o_orderkey % 5 < 3""")
def hint_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints on headings that look like articles, put to the first paragraph of which a unit holds them; some are held by none, some don't begin with an article."""
    o = table(spark, sf_dir, "orders")
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    head = F.concat(F.lit("第"), text, F.lit("条"))
    at = F.floor(key / 3) * 10
    units = F.array(F.struct((at + 3).alias("pos"), F.concat(F.lit("前段。"), head, F.lit("番号"), text, F.lit("は後にも出る。")).alias("text")), F.struct((at + F.when(key % 4 == 0, 1).otherwise(2)).alias("pos"), F.concat(F.lit("前段。\n"), head, F.lit(" 番号"), text, F.lit("を定める。")).alias("text")))
    paragraphs = o.select(F.col("o_custkey").alias("doc_id"), F.explode(units).alias("u")).select("doc_id", "u.*")
    said = F.when(key % 5 < 3, F.concat(F.lit("　"), head, F.lit("　番号"), text)).when(key % 5 == 3, F.concat(head, F.lit("未知"))).otherwise(F.concat(F.lit("番号"), text))
    return V.attached(o.select(F.col("o_custkey").alias("doc_id"), said.alias("hint")), paragraphs)
