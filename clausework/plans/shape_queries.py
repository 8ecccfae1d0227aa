"""Queries on documents of richer shapes: chapters, sections, branches, ranges, sub-items, styled paragraphs, all kinds of marks and spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, editing, variants
from ..operators import structure as S
from ..operators import verify as V
from .inputs import pick, table
from .registry import query

#: A rule with chapters, a section, a branch, a deleted range, items of three depths and an appendix; # is the document's number.
_CHAPTERS = [
    "規程#", "第１章　総則", "第１節　通則", "（目的）", "第１条　この規程は受注#を定める。", "第１条の２（定義）　次の各号のとおりとする。", "（１）甲", "　ア　乙", "　　（ア）丙", "　イ　丁", "（２）戊",
    "第２条～第４条　削除", "第２章　細則", "第５条【届出】　従業員は、", "届け出る。", "２　会社は受理する。", "別表第１（第５条関係）", "金額",
]


def _documents(spark: SparkSession, sf_dir: str, rows: list[tuple[str, str | None]]) -> DataFrame:
    """doc_id, pos, line, kind: the rows as a document of each part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"))
    lines = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(t).alias("line"), F.lit(kind).cast("string").alias("kind")) for k, (t, kind) in enumerate(rows)))
    df = part.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.*")
    return df.withColumn("line", F.replace("line", F.lit("#"), T.wide(F.col("doc_id"))))


@query("""SELECT p_partkey AS doc_id, CAST(k - 1 AS INTEGER) AS row_no, replace([
 '前付け:規程#', '第１章|総則', '節:第１節　通則', '第１条（目的）', '  1:この規程は受注#を定める。', '第１条の２（定義）', '  1:次の各号のとおりとする。', '    1)甲', '      1)乙', '        1)丙', '      2)丁', '    2)戊',
 '第２条（）', '  1:削除', '第３条（）', '  1:削除', '第４条（）', '  1:削除', '第２章|細則', '第５条（届出）', '  1:従業員は、届け出る。', '  2:会社は受理する。', '後付け:別表第１（第５条関係） / 金額'][k],
 '#', translate(CAST(p_partkey AS VARCHAR), '0123456789', '０１２３４５６７８９')) AS text FROM part, (SELECT unnest(range(1, 24)) AS k)""")
def outline_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of rules with chapters, a section, a branch number, a deleted range, three depths of items and an appendix."""
    return S.outlines(_documents(spark, sf_dir, [(t, None) for t in _CHAPTERS]).drop("kind"))


@query("""SELECT p_partkey AS doc_id, 2::BIGINT AS chapters, 6::BIGINT AS articles FROM part""")
def summary_of_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and articles of the same rules."""
    from ..operators import emit

    return emit.counts(S.nodes(S.read(_documents(spark, sf_dir, [(t, None) for t in _CHAPTERS]).drop("kind"))))


@query("""SELECT p_partkey AS doc_id, CAST(k - 1 AS INTEGER) AS row_no, replace(['前付け:就業規則', '第1章|総則', '第1条（目的）', '  1:会社は受注#を有効とする。', '  2:次の書類を提出する。', '    1)申込書', '    2)誓約書', '第2条（適用）', '  1:従業員に適用する。', '後付け:附　則 / 公布の日から施行する。'][k],
 '#', translate(CAST(p_partkey AS VARCHAR), '0123456789', '０１２３４５６７８９')) AS text FROM part, (SELECT unnest(range(1, 11)) AS k)""")
def outline_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of documents whose chapters, articles, paragraphs and items are told by style or numbering alone, as office files have them."""
    rows = [("就業規則", None), ("総則", "chapter"), ("（目的）", "article"), ("会社は受注#を有効とする。", "paragraph"), ("次の書類を提出する。", "paragraph"), ("申込書", "item"), ("誓約書", "item"), ("（適用）", "article"), ("従業員に適用する。", "paragraph"), ("附　則", None), ("公布の日から施行する。", None)]
    return S.outlines(_documents(spark, sf_dir, rows))


@query("""SELECT l_orderkey, l_linenumber, [
 'paren_zen_num', 'paren_zen_num', 'num_paren', 'paren_zen_kanji', 'paren_han_kanji', 'maru', 'num_dot', 'kanji', 'kanji', 'paren_zen_kana', 'paren_han_kana', 'paren_zen_alpha', 'paren_han_alpha', 'paren_roman', 'katakana', 'katakana', 'alpha'][l_partkey % 17 + 1] AS kind,
 [12, 3, 12, 13, 13, 21, 12, 20, 11, 7, 7, 4, 4, 9, 7, 7, 4][l_partkey % 17 + 1]::BIGINT AS number, '品' || l_suppkey AS body FROM lineitem""")
def marker_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of mark in each way to write it."""
    signs = ["（１２）", "⑶", "12)", "（十三）", "(十三)", "㉑", "１２．", "二十、", "十一　", "（キ）", "(キ)", "（d）", "(d)", "(ix)", "キ．", "キ　", "d)"]
    m = T.marker(F.concat(F.lit("　"), pick(F.col("l_partkey"), *signs), F.lit("品"), F.col("l_suppkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_linenumber", "m.kind", "m.number", "m.body")


#: All groups of competing spellings, as SQL.
_GROUPS = "[" + ", ".join("{'category': '" + c + "', 'forms': [" + ", ".join(f"'{f}'" for f in forms) + "]}" for c, forms in variants.dictionary()) + "]"


@query(f"""WITH g AS (SELECT unnest({_GROUPS}) AS g, generate_subscripts({_GROUPS}, 1) - 1 AS k)
SELECT p_partkey AS doc_id, g.category AS category, k::INTEGER AS group_no, unnest(g.forms) AS form, 1::BIGINT AS n FROM part JOIN g ON p_partkey % {len(variants.dictionary())} = k""")
def variant_groups_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of competing spellings, each document with all forms of one."""
    quoted = ["と".join(f"「{f}」" for f in forms) for _, forms in variants.dictionary()]
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pick(F.col("p_partkey"), *quoted).alias("text"))
    return variants.group_counts(docs)


@query("""SELECT p_partkey, p_partkey % 10 + 1 AS n, CAST(p_partkey % 10 + 1 AS VARCHAR) AS digits, ['１', '２', '３', '４', '５', '６', '７', '８', '９', '１０'][p_partkey % 10 + 1] AS wide, substr('①②③④⑤⑥⑦⑧⑨⑩', p_partkey % 10 + 1, 1) AS circled,
 substr('アイウエオカキクケコ', p_partkey % 10 + 1, 1) AS kana, substr('イロハニホヘトチリヌ', p_partkey % 10 + 1, 1) AS iroha, substr('ｱｲｳｴｵｶｷｸｹｺ', p_partkey % 10 + 1, 1) AS half_kana, substr('abcdefghij', p_partkey % 10 + 1, 1) AS lower_letter, substr('ABCDEFGHIJ', p_partkey % 10 + 1, 1) AS upper_letter,
 ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'][p_partkey % 10 + 1] AS lower_roman, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][p_partkey % 10 + 1] AS upper_roman, substr('一二三四五六七八九十', p_partkey % 10 + 1, 1) AS kanji, '' AS none FROM part""")
def number_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in every style in which levels are numbered."""
    styles = {"digits": "decimal", "wide": "decimalFullWidth", "circled": "decimalEnclosedCircle", "kana": "aiueoFullWidth", "iroha": "iroha", "half_kana": "aiueo", "lower_letter": "lowerLetter", "upper_letter": "upperLetter", "lower_roman": "lowerRoman", "upper_roman": "upperRoman", "kanji": "kanji", "none": "none"}
    n = F.col("p_partkey") % 10 + 1
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), *(T.format_number(fmt, n).alias(name) for name, fmt in styles.items()))


def _article(n: int, title: str, *bodies: str) -> str:
    paragraphs = ",".join(f'{{"type":"paragraph","number":{k},"body":"{b}","items":[]}}' for k, b in enumerate(bodies, 1))
    return f'{{"type":"article","number":{n},"number_str":"第{T.WIDE[n]}条","title":"{title}","title_note":"","paragraphs":[{paragraphs}]}}'


def _trees(spark: SparkSession, sf_dir: str, text: str, name: str = "tree") -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.replace(F.lit(text), F.lit("#"), F.col("p_partkey").cast("string")).alias(name))


def _articles(trees: DataFrame) -> DataFrame:
    """doc_id, place, number_str, title and the bodies of the paragraphs of each article."""
    kind = "array<struct<number_str:string,title:string,paragraphs:array<struct<number:bigint,body:string>>>>"
    a = trees.select("doc_id", F.posexplode(F.from_json("tree", kind)).alias("place", "a"))
    return a.select("doc_id", "place", "a.number_str", "a.title", F.array_join(F.transform("a.paragraphs", lambda p: F.concat(p["number"].cast("string"), F.lit(":"), p["body"])), "/").alias("paragraphs"))


@query("""SELECT p_partkey AS doc_id, CAST(k - 1 AS INTEGER) AS place, ['第1条', '第2条', '第3条'][k] AS number_str, ['甲', '', '乙'][k] AS title, CASE k WHEN 1 THEN list_aggregate(['1:一' || p_partkey || '。', '2:二。'][1:p_partkey % 2 + 1], 'string_agg', '/') WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '1:二。/2:三。' ELSE '1:三。' END ELSE '1:四。' END AS paragraphs
FROM part, (SELECT unnest([1, 2, 3]) AS k)""")
def split_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article split before its second or third paragraph; all that follows is numbered anew."""
    trees = _trees(spark, sf_dir, f"[{_article(1, '甲', '一#。', '二。', '三。')},{_article(2, '乙', '四。')}]")
    return _articles(editing.splits(trees.withColumn("place", F.lit(0)).withColumn("paragraph", (F.col("doc_id") % 2 + 1).cast("int"))))


@query("""SELECT p_partkey AS doc_id, CAST(k - 1 AS INTEGER) AS place, ['第1条', '第2条'][k] AS number_str, CASE WHEN k = 1 THEN '甲' WHEN p_partkey % 2 = 0 THEN '丙' ELSE '乙' END AS title,
 CASE WHEN p_partkey % 2 = 0 THEN ['1:一' || p_partkey || '。/2:二。', '1:三。'][k] ELSE ['1:一' || p_partkey || '。', '1:二。/2:三。'][k] END AS paragraphs FROM part, (SELECT unnest([1, 2]) AS k)""")
def merge_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first or second article merged with the one behind it."""
    trees = _trees(spark, sf_dir, f"[{_article(1, '甲', '一#。')},{_article(2, '乙', '二。')},{_article(3, '丙', '三。')}]")
    return _articles(editing.merges(trees.withColumn("place", (F.col("doc_id") % 2).cast("int"))))


@query("""SELECT p_partkey AS doc_id, unnest([0, 1, 1, 1])::INTEGER AS line, unnest(['第1条（題）', '1　本文' || p_partkey || 'を', '速やかに', '定める。']) AS text, unnest([false, false, true, false]) AS changed FROM part""")
def compare_underline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is underlined on the new side of a changed article."""
    old, new = (_trees(spark, sf_dir, f"[{_article(1, '題', body)}]", side) for side, body in (("old", "本文#を定める。"), ("new", "本文#を速やかに定める。")))
    rows = compare.rows(old.join(new, "doc_id"))
    lines = rows.select("doc_id", F.posexplode(F.from_json("new", "array<array<array<string>>>")).alias("line", "runs"))
    return lines.select("doc_id", "line", F.explode("runs").alias("r")).select("doc_id", "line", F.get("r", 0).alias("text"), F.get("r", 1).cast("boolean").alias("changed"))


@query("""SELECT o_orderkey, '受注' || o_orderkey || 'をABC「済」とする。' AS norm FROM orders""")
def verify_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as they are compared: signs and numbers at their front, widths, blanks and half-width brackets make no difference."""
    line = F.concat(pick(F.col("o_orderkey"), "（１）", "２　", "第３条　", "①"), F.lit("受注"), T.wide(F.col("o_orderkey")), F.lit(" をＡＢＣ｢済｣とする。"))
    return V.sentences(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))).select("o_orderkey", "norm")


#: What a document says besides one group of the dictionary, by the remainders of its number.
_SAID = [(3, "「役職者」「管理職」「役職者」"), (4, "「サーバー」「サーバ」「サーバー」"), (5, "「データー」「データ」"), (7, "「見積」「見積り」見積る"), (11, "前項の規程による。")]


@query(f"""WITH g AS (SELECT unnest({_GROUPS}) AS g, generate_subscripts({_GROUPS}, 1) - 1 AS k),
e AS (SELECT p_partkey AS doc_id, unnest([{{'m': 3, 'category': '独自', 'forms': ['役職者', '管理職'], 'n': [2, 1]}}, {{'m': 4, 'category': 'カタカナ', 'forms': ['サーバー', 'サーバ'], 'n': [2, 1]}}, {{'m': 7, 'category': '送り仮名', 'forms': ['見積', '見積り'], 'n': [1, 1]}}]) AS e FROM part)
SELECT p_partkey AS doc_id, g.category AS category, array_to_string(list_sort(g.forms), ',') AS forms, unnest(g.forms) AS form, 1::BIGINT AS n, NULL AS correct FROM part JOIN g ON p_partkey % {len(variants.dictionary())} = k
UNION ALL SELECT doc_id, e.category, array_to_string(e.forms, ','), unnest(e.forms), unnest(e.n), NULL FROM e WHERE doc_id % e.m = 0
UNION ALL SELECT p_partkey, '用語の誤用', '規程', '規程', 1, '規定' FROM part WHERE p_partkey % 11 = 0""")
def variant_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings by the dictionary, by groups of one's own (one of which is in the dictionary), by what documents say themselves, less an excluded form; and misuses."""
    quoted = ["と".join(f"「{f}」" for f in forms) for _, forms in variants.dictionary()]
    k = F.col("p_partkey")
    text = F.concat(pick(k, *quoted), *(F.when(k % m == 0, F.lit(t)).otherwise("") for m, t in _SAID))
    docs = table(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text"))
    out = variants.analyze(docs, extra_groups=(("独自", ("役職者", "管理職")), ("重複", variants.dictionary()[0][1])), exclude_forms=("データー",))
    return out.withColumn("forms", F.array_join("forms", ","))
