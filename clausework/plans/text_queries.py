"""Queries on lines, numerals, spellings and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from ..operators import refs as R
from ..operators import structure as S
from ..operators import variants as V
from .inputs import ORDERS, orders, pick, pick_sql, table
from .registry import query

_WIDE = "translate(CAST({} AS VARCHAR), '0123456789', '０１２３４５６７８９')"


@query(r"""WITH l AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
 p AS (SELECT doc_id, pos, ['', '　', '　 ', chr(9)][pos % 4 + 1] || line AS line FROM l)
SELECT doc_id, pos, CAST(len(lead) + len(regexp_replace(lead, '[^　]', '', 'g')) + 3 * len(regexp_replace(lead, '[^\t]', '', 'g')) AS INTEGER) AS indent, right(regexp_replace(line, '[　 \t]+$', ''), 1) AS last FROM (SELECT *, regexp_extract(line, '^[　 \t]*') AS lead FROM p)""")
def line_features_indent_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indent and last character of each line, some of them set in."""
    rows = S.lines(table(spark, sf_dir, "documents"))
    line = F.concat(pick(F.col("pos"), "", "　", "　 ", "\t"), F.col("line"))
    return rows.select("doc_id", "pos", T.indent_width(line).cast("int").alias("indent"), T.last_char(line).alias("last"))


_ENDS = ["は、", "及び", "において", "。", "する", "規定", "）", "より"]


@query(f"""SELECT o_orderkey, {pick_sql('o_orderkey', 'y', 'y', 'y', 'n', 'n', 'y', 'n', 'y')} = 'y' AS mid_sentence, {pick_sql('o_orderkey', 'y', 'y', 'y', 'n', 'n', 'n', 'n', 'y')} = 'y' AS connective FROM orders""")
def mid_sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break off inside a sentence."""
    line = F.concat(F.lit("受注"), F.col("o_orderkey").cast("string"), pick(F.col("o_orderkey"), *_ENDS))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.mid_sentence(line).alias("mid_sentence"), T.connective(line).alias("connective"))


@query(f"""SELECT o_orderkey, o_orderkey % 2 = 0 AS forecast, {pick_sql('o_orderkey', '', '丸数字痕跡', '項目値一覧痕跡', 'とき連続', '名詞句連続')} AS traces FROM orders""")
def forecast_and_split_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that announce a list, and traces of one that was run into the text."""
    k = F.col("o_orderkey")
    body = F.concat(F.when(k % 2 == 0, "次の各号に").otherwise("前項の者に"), pick(k, "よる。", "よる。①申込②承諾", "よる。氏名：甲、住所：乙", "よる。病気のとき、事故のとき。", "よる。行うこと、守ること、出すこと。"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.forecast(body).alias("forecast"), F.array_join(T.split_traces(body), ",").alias("traces"))


@query("SELECT p_partkey, p_partkey % 10000 AS by_unit, CASE WHEN p_partkey % 10000 > 0 THEN p_partkey % 10000 ELSE 1 END AS number FROM part")
def numerals_kanji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kanji numerals read back."""
    n = F.col("p_partkey") % 10_000
    digit = lambda d, least: F.when(d > least, F.substring(F.lit(X.KANJI_DIGITS), (d + 1).cast("int"), F.lit(1))).otherwise("")
    th = F.floor(n / 1000)
    text = F.concat(F.when(th > 0, F.concat(digit(th, 1), F.lit("千"))).otherwise(""), T.kanji_numeral(n % 1000))
    return table(spark, sf_dir, "part").select("p_partkey", T.kanji_number(text).alias("by_unit"), T.number(text).alias("number"))


@query(f"""SELECT p_partkey, CASE WHEN p_size <= 20 THEN chr(9311 + p_size) WHEN p_size <= 35 THEN chr(12860 + p_size) ELSE chr(12941 + p_size) END AS circled, {_WIDE.format('p_size')} AS wide, CASE WHEN p_size <= 26 THEN chr(96 + p_size) ELSE CAST(p_size AS VARCHAR) END AS letter,
 CASE WHEN p_size <= 21 THEN substr('{X.IROHA}', p_size, 1) ELSE CAST(p_size AS VARCHAR) END AS iroha,
 CASE WHEN p_size >= 10 THEN CASE WHEN p_size >= 20 THEN substr('一二三四五六七八九', p_size // 10, 1) ELSE '' END || '十' ELSE '' END || CASE WHEN p_size % 10 > 0 THEN substr('一二三四五六七八九', p_size % 10, 1) ELSE '' END AS kanji FROM part""".replace("<= 21", f"<= {len(X.IROHA)}"))
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the styles of levels."""
    n = F.col("p_size")
    f = T.format_number
    return table(spark, sf_dir, "part").select("p_partkey", f("decimalEnclosedCircle", n).alias("circled"), f("decimalFullWidth", n).alias("wide"), f("lowerLetter", n).alias("letter"), f("iroha", n).alias("iroha"), f("kanji", n).alias("kanji"))


@query(f"""SELECT o_orderkey, {pick_sql('o_orderkey', '（１）', '２　', '', '①　')} AS mark FROM orders""")
def lead_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs before bodies in their lines."""
    body = F.concat(F.lit("受注"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.lead_mark(F.concat(pick(F.col("o_orderkey"), "（１）", "２　", "", "①　"), body), body).alias("mark"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::INTEGER AS half, len(regexp_extract_all(text, '[０-９]+'))::INTEGER AS \"full\" FROM documents")
def width_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits of either width."""
    return table(spark, sf_dir, "documents").select("doc_id", T.width_counts(F.col("text")).alias("w")).select("doc_id", "w.half", "w.full")


_CLAUSES = ["申出を受ける。", "申し出を受け、支払の手続をとる。", "ユーザーの登録を行う。", "ユーザが支払った。"]


@query(f"""SELECT o_custkey AS doc_id, token, count(*) AS n FROM orders, LATERAL (SELECT unnest([['申出', '受け'], ['申し出', '受け', '支払', '手続'], ['ユーザー', '登録'], ['ユーザ']][CAST(o_orderkey AS BIGINT) % 4 + 1]) AS token) GROUP BY 1, 2""")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns and katakana words of documents; words used as verbs don't count."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), pick(F.col("o_orderkey"), *_CLAUSES).alias("text"))
    return V.tokens(docs)


@query("""WITH t AS (SELECT o_custkey AS doc_id, o_orderkey % 2 AS a, o_orderkey % 3 AS b FROM orders), f AS (
 SELECT doc_id, 'かな漢字' AS category, [CASE a WHEN 0 THEN '及び' ELSE 'および' END] AS forms FROM t UNION ALL SELECT doc_id, '用語', CASE b WHEN 0 THEN ['従業員'] WHEN 1 THEN ['職員'] ELSE [] END FROM t), c AS (
 SELECT doc_id, category, form, count(*) AS n FROM (SELECT doc_id, category, unnest(forms) AS form FROM f) GROUP BY ALL)
SELECT * FROM c WHERE (doc_id, category) IN (SELECT (doc_id, category) FROM c GROUP BY doc_id, category HAVING count(*) > 1)""")
def variant_groups_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competing spellings of the dictionary; 正社員 is not 社員."""
    k = F.col("o_orderkey")
    clause = F.concat(pick(k, "甲及び乙は、", "甲および乙は、"), pick(k, "従業員とする。", "職員とする。", "正社員とする。"))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.collect_list(clause), "").alias("text"))
    return V.group_counts(docs).select("doc_id", "category", "form", "n")


@query("""WITH t AS (SELECT o_custkey AS doc_id, ['サーバー', 'サーバ', 'ユーザー', 'データー', 'データ'][CAST(o_orderkey AS BIGINT) % 5 + 1] AS token FROM orders)
SELECT doc_id, rtrim(token, 'ー') AS stem, array_to_string(list_sort(list_distinct(list(token))), ',') AS forms FROM t GROUP BY 1, 2 HAVING count(DISTINCT token) > 1""")
def katakana_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katakana words that differ in long vowel marks."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), pick(F.col("o_orderkey"), "サーバー", "サーバ", "ユーザー", "データー", "データ").alias("text"))
    return V.katakana_groups(V.tokens(docs)).select("doc_id", "stem", F.array_join("forms", ",").alias("forms"))


@query("""WITH t AS (SELECT o_custkey AS doc_id, ['取扱', '取扱い', '申出', '申し出', '届出'][CAST(o_orderkey AS BIGINT) % 5 + 1] AS token FROM orders)
SELECT doc_id, replace(replace(token, 'い', ''), 'し', '') AS stem, array_to_string(list_sort(list_distinct(list(token))), ',') AS forms FROM t GROUP BY 1, 2 HAVING count(DISTINCT token) > 1""")
def okurigana_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns with the same kanji and other kana."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(pick(F.col("o_orderkey"), "取扱", "取扱い", "申出", "申し出", "届出"), F.lit("、")).alias("text"))
    return V.okurigana_groups(V.tokens(docs)).select("doc_id", "stem", F.array_join("forms", ",").alias("forms"))


@query("""SELECT doc_id, rule_id, wrong, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_custkey AS doc_id, r.* FROM orders, LATERAL (SELECT ['kitei_verb', 'kitei_ref', 'bunsho_kitei', 'self_ref', NULL][CAST(o_orderkey AS BIGINT) % 5 + 1] AS rule_id, ['規程', '規程', '規定', '規程', NULL][CAST(o_orderkey AS BIGINT) % 5 + 1] AS wrong, 1 AS n) r) WHERE rule_id IS NOT NULL GROUP BY ALL""")
def misuse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words used for others that sound alike."""
    clause = pick(F.col("o_orderkey"), "別に規程する。", "前項の規程による。", "育児休業規定による。", "この規程による。", "前項の規定による。")
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.collect_list(clause), "").alias("text")).withColumn("kind", F.lit("規則"))
    return V.misuses(docs, kind="kind").select("doc_id", "rule_id", "wrong", F.col("n").cast("long").alias("n"))


@query("""SELECT o_orderkey, s.* FROM orders, LATERAL (SELECT unnest(CASE o_orderkey % 3 WHEN 0 THEN [{'start': 1, 'end': 3, 'surface': '及び', 'misuse': false}, {'start': 5, 'end': 8, 'surface': '従業員', 'misuse': false}] WHEN 1 THEN [{'start': 3, 'end': 5, 'surface': '規程', 'misuse': true}] ELSE [{'start': 0, 'end': 6, 'surface': '年次有給休暇', 'misuse': false}] END, recursive := true)) s""")
def span_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where competing spellings and misuses stand; longer ones first, none overlapping."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", pick(F.col("o_orderkey"), "甲及び乙の従業員は正社員とする。", "前項の規程とする。", "年次有給休暇とする。").alias("text"))
    return V.spans(docs, "o_orderkey").select("o_orderkey", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "surface", "misuse")


@query("""SELECT o_orderkey, r.* FROM orders, LATERAL (SELECT unnest([{'ref': '第' || o_orderkey || '条', 'article': o_orderkey, 'branch': 0::BIGINT}, {'ref': '第' || translate(CAST(o_custkey AS VARCHAR), '0123456789', '０１２３４５６７８９') || '条の２', 'article': o_custkey, 'branch': 2::BIGINT}], recursive := true)) r""")
def ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to articles, wherever they lead."""
    body = F.concat(F.lit("第"), F.col("o_orderkey").cast("string"), F.lit("条及び第"), T.wide(F.col("o_custkey")), F.lit("条の２を準用する。"))
    return R.find_plain(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))).select("o_orderkey", "ref", "article", "branch")


@query("""SELECT o_orderkey, CAST(k AS INTEGER) AS ref_no, CASE k WHEN 0 THEN o_orderkey ELSE o_custkey END AS article, o_orderkey % 3 = 1 AS external FROM orders, (SELECT unnest([0, 1]) AS k)""")
def ref_external_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to other laws, and those linked to them."""
    k = F.col("o_orderkey")
    body = F.concat(pick(k, "会社は、", "労働基準法（昭和22年法律第49号）", "この規則"), F.lit("第"), k.cast("string"), F.lit("条第１項及び第"), F.col("o_custkey").cast("string"), F.lit("条による。"))
    return R.find(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))).select("o_orderkey", "ref_no", "article", "external")


@query(f"""SELECT o_custkey AS doc_id, nth, CASE WHEN o_orderkey % 3 + 1 > nth % 2 + 1 THEN 'para' WHEN o_orderkey % 4 + 1 > 2 THEN 'item' END AS kind FROM {ORDERS} WHERE o_orderkey % 3 + 1 > nth % 2 + 1 OR o_orderkey % 4 + 1 > 2""")
def ref_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to paragraphs and items that aren't there. Article n has n % 2 + 1 paragraphs of two items."""
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "doc_id")
    k, n = F.col("o_orderkey"), F.col("nth")
    body = F.concat(F.lit("前条は、第"), n.cast("string"), F.lit("条第"), T.wide(k % 3 + 1), F.lit("項第"), T.kanji_numeral(k % 4 + 1), F.lit("号による。"))
    articles = o.select("doc_id", n.alias("ord"), n.alias("rid"), n.alias("number"), F.lit(0).cast("long").alias("branch"))
    targets = R.keys(articles).withColumn("n_paragraphs", F.col("rid") % 2 + 1).withColumn("items", F.array_repeat(F.lit(2).cast("long"), (F.col("rid") % 2 + 1).cast("int")))
    return R.check(R.find(o.select("doc_id", "nth", body.alias("body"))), targets).select("doc_id", "nth", "kind")


@query(f"""SELECT o_custkey AS doc_id, nth, '甲は第' || CASE WHEN nth % 4 = 0 THEN nth || '条［参照先なし］' ELSE (nth - nth // 4) || '条' END || 'に、乙は労働基準法第' || nth || '条による。' AS rewritten, CASE WHEN nth % 4 = 0 THEN 1 ELSE 0 END::INTEGER AS n_missing FROM {ORDERS}""")
def ref_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References rewritten once every fourth article is gone; what led there is marked."""
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "doc_id")
    n = F.col("nth")
    articles = o.select("doc_id", n.alias("ord"), n.alias("rid"), n.alias("number"), F.lit(0).cast("long").alias("branch"))
    after = o.filter("nth % 4 <> 0").select("doc_id", n.alias("rid"), (n - F.floor(n / 4)).alias("number"))
    body = F.concat(F.lit("甲は第"), n.cast("string"), F.lit("条に、乙は労働基準法第"), n.cast("string"), F.lit("条による。"))
    return R.rewrite(o.select("doc_id", "nth", body.alias("body")), R.keys(articles), after).select("doc_id", "nth", "rewritten", F.size("missing").alias("n_missing"))
