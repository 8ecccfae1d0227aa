"""Queries on how paragraphs are shown: styles that inherit, formats in effect, numbers of lists, references in formatted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import formats, numbering, overlay
from .inputs import ITEMS, ORDERS, items, orders, pick, table
from .registry import query

#: Parts to a document: each is a style, based on the part before; the first on none or, in every other document, on the last, in a circle.
STYLES = 40

_ATTRIBUTES = """SELECT p_partkey // 40 AS doc_id, p_partkey AS style, CASE WHEN p_partkey % 40 > 0 THEN p_partkey - 1 WHEN p_partkey // 40 % 2 = 1 THEN p_partkey + 39 END AS based_on,
 CASE WHEN p_partkey % 7 = 0 THEN ['left', 'center', 'right', 'both'][p_size % 4 + 1] END AS jc,
 CASE WHEN p_partkey % 5 = 1 THEN {'a': CAST(p_size * 20 AS VARCHAR), 'l': CASE WHEN p_partkey % 10 = 1 THEN '50' END} END AS bef,
 CASE WHEN p_partkey % 6 = 2 THEN {'a': CAST(p_size * 10 AS VARCHAR), 'l': ['exact', 'auto', 'atLeast'][p_size % 3 + 1]} END AS lin,
 CASE WHEN p_partkey % 9 = 3 THEN {'a': CAST(p_size * 100 AS VARCHAR), 'l': CASE WHEN p_partkey % 18 = 3 THEN CAST(p_size * 10 AS VARCHAR) END} END AS lef,
 CASE WHEN p_partkey % 11 IN (4, 5) THEN {'a': CASE WHEN p_partkey % 11 = 4 THEN '210' END, 'l': CASE WHEN p_partkey % 11 = 5 THEN '420' END} END AS fir,
 CASE WHEN p_partkey % 8 = 6 THEN CAST(p_partkey % 3 AS VARCHAR) END AS num, CASE WHEN p_partkey % 16 = 7 THEN CAST(p_partkey % 4 AS VARCHAR) END AS ilvl,
 CASE WHEN p_partkey % 13 = 2 THEN CAST(16 + p_size % 9 AS VARCHAR) END AS sz, CASE WHEN p_partkey % 10 = 5 THEN ['1', '0', 'off'][p_size % 3 + 1] END AS b,
 CASE WHEN p_partkey % 14 = 3 THEN {'a': CASE WHEN p_size % 3 > 0 THEN '明朝' || p_size % 5 END, 'l': CASE WHEN p_size % 3 = 0 THEN 'minorEastAsia' END} END AS eas, CASE WHEN p_partkey % 12 = 4 THEN 'Latin' || p_size % 4 END AS lat
 FROM part"""
_NAMES = ("jc", "bef", "lin", "lef", "fir", "num", "ilvl", "sz", "b", "eas", "lat")
#: Styles with all that they inherit.
_CHAINS = f"""a AS ({_ATTRIBUTES}), c(doc_id, style, held, depth) AS (
 SELECT doc_id, style, style, 0 FROM a UNION ALL SELECT c.doc_id, c.style, a.based_on, depth + 1 FROM c JOIN a ON a.style = c.held WHERE a.based_on IS NOT NULL AND depth < 39
), s AS (SELECT c.doc_id, c.style, {", ".join(f"arg_min({x}, depth) FILTER (WHERE {x} IS NOT NULL) AS {x}" for x in _NAMES)} FROM c JOIN a ON a.style = c.held GROUP BY ALL)"""


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, style, based_on, tag, attr, value; a style without attributes has one row without a tag."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    rows = [
        ("jc", "val", k % 7 == 0, pick(size, "left", "center", "right", "both")),
        ("spacing", "before", k % 5 == 1, text(size * 20)), ("spacing", "beforeLines", k % 10 == 1, F.lit("50")),
        ("spacing", "line", k % 6 == 2, text(size * 10)), ("spacing", "lineRule", k % 6 == 2, pick(size, "exact", "auto", "atLeast")),
        ("ind", "left", k % 9 == 3, text(size * 100)), ("ind", "leftChars", k % 18 == 3, text(size * 10)),
        ("ind", "firstLine", k % 11 == 4, F.lit("210")), ("ind", "hanging", k % 11 == 5, F.lit("420")),
        ("numId", "val", k % 8 == 6, text(k % 3)), ("ilvl", "val", k % 16 == 7, text(k % 4)),
        ("sz", "val", k % 13 == 2, text(16 + size % 9)), ("b", "val", k % 10 == 5, pick(size, "1", "0", "off")),
        ("rFonts", "eastAsia", (k % 14 == 3) & (size % 3 > 0), F.concat(F.lit("明朝"), text(size % 5))), ("rFonts", "eastAsiaTheme", (k % 14 == 3) & (size % 3 == 0), F.lit("minorEastAsia")),
        ("rFonts", "ascii", k % 12 == 4, F.concat(F.lit("Latin"), text(size % 4))), (None, None, F.lit(True), F.lit(None)),
    ]
    doc = F.floor(k / STYLES)
    base = F.when(k % STYLES > 0, k - 1).when(doc % 2 == 1, k + STYLES - 1)
    given = F.filter(F.array(*(F.struct(F.lit(t).cast("string").alias("tag"), F.lit(a).cast("string").alias("attr"), v.cast("string").alias("value"), w.alias("given")) for t, a, w, v in rows)), lambda x: x["given"])
    return table(spark, sf_dir, "part").select(doc.alias("doc_id"), k.alias("style"), base.alias("based_on"), F.explode(given).alias("x")).select("doc_id", "style", "based_on", "x.tag", "x.attr", "x.value")


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = formats.families(_attributes(spark, sf_dir), ["doc_id", "style", "based_on"])
    return formats.inherited(own, list(formats.FAMILIES))


@query(f"""WITH RECURSIVE {_CHAINS} SELECT doc_id, style, jc AS align, bef.a AS before, bef.l AS before_lines, lin.a AS line, lin.l AS line_rule, lef.a AS left_twips, lef.l AS left_chars, fir.a AS first_line, fir.l AS hanging, num, ilvl, sz AS size, b AS bold, eas.a AS east, eas.l AS theme, lat AS latin FROM s""")
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute in effect of every style, down chains of forty and around circles."""
    names = {"align.val": "align", "before.before": "before", "before.beforeLines": "before_lines", "line.line": "line", "line.lineRule": "line_rule", "left.left": "left_twips", "left.leftChars": "left_chars", "first.firstLine": "first_line", "first.hanging": "hanging", "num.val": "num", "ilvl.val": "ilvl", "size.val": "size", "bold.val": "bold", "east.eastAsia": "east", "east.eastAsiaTheme": "theme", "latin.ascii": "latin"}
    return _styles(spark, sf_dir).select("doc_id", "style", *(F.col(c).alias(n) for c, n in names.items()))


_PARAGRAPHS = f"""SELECT l_partkey // 40 AS doc_id, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey END AS style, CASE WHEN l_linenumber = 1 THEN 'center' END AS jc,
 CASE WHEN l_linenumber = 2 THEN CAST(CAST(l_quantity AS INTEGER) * 10 AS VARCHAR) END AS lef, CASE WHEN l_linenumber = 3 THEN CAST(l_suppkey % 3 AS VARCHAR) END AS num, CASE WHEN l_linenumber = 4 THEN '120' END AS aft FROM {ITEMS}"""


@query(f"""WITH RECURSIVE {_CHAINS}, p AS ({_PARAGRAPHS}), n AS (
 SELECT p.*, s.jc AS sjc, s.bef, s.lin, s.lef AS slef, s.fir, nullif(coalesce(p.num, CASE WHEN p.style IS NOT NULL THEN s.num END), '0') AS nid, coalesce(CASE WHEN p.style IS NOT NULL THEN CAST(s.ilvl AS INTEGER) END, 0) AS lvl
 FROM p LEFT JOIN s ON s.style = coalesce(p.style, p.doc_id * 40 + 5)
), f AS (
 SELECT *, nid IN ('1', '2') AND lvl < 3 AS there, CASE WHEN there THEN CAST(lvl * 210 + CAST(nid AS INTEGER) AS VARCHAR) END AS llef, CASE WHEN there AND lvl = 1 THEN 'right' END AS ljc,
  CASE WHEN p.num IS NOT NULL THEN coalesce(jc, ljc, sjc) ELSE coalesce(jc, sjc, ljc) END AS align,
  CASE WHEN lef IS NOT NULL THEN CAST(lef AS DOUBLE) / 210 WHEN llef IS NOT NULL AND (p.num IS NOT NULL OR slef IS NULL) THEN CAST(llef AS DOUBLE) / 210 WHEN CAST(slef.l AS INTEGER) <> 0 THEN CAST(slef.l AS DOUBLE) / 100 ELSE coalesce(CAST(slef.a AS DOUBLE) / 210, 0) END AS l,
  CASE WHEN there AND (p.num IS NOT NULL OR fir IS NULL) THEN {{'a': NULL, 'l': '210'}} ELSE fir END AS fr FROM n p
) SELECT doc_id, pos, coalesce(align, 'both') AS align, CASE WHEN bef.l IS NOT NULL THEN CAST(bef.l AS DOUBLE) / 100 * 400 / 20 ELSE CAST(bef.a AS DOUBLE) / 20 END AS before, CAST(coalesce(aft, '60') AS DOUBLE) / 20 AS after,
 CASE WHEN lin.l IN ('exact', 'atLeast') THEN CAST(lin.a AS DOUBLE) / 20 END AS line, round(CASE WHEN fr.l IS NOT NULL THEN l - CAST(fr.l AS DOUBLE) / 210 ELSE l + coalesce(CAST(fr.a AS DOUBLE) / 210, 0) END, 6) AS first, round(l, 6) AS left_side FROM f""")
def effective_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment, spacing and indents in effect of every line item as a paragraph: its own, its number's, its style's and the document's."""
    k, n = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    p = items(spark, sf_dir).withColumns({"doc_id": F.floor(F.col("l_partkey") / STYLES), "pos": F.col("l_orderkey") * 8 + k})
    rows = [(None, None, F.lit(True), F.lit(None)), ("jc", "val", k == 1, F.lit("center")), ("ind", "left", k == 2, (n * 10).cast("string")), ("numId", "val", k == 3, (F.col("l_suppkey") % 3).cast("string")), ("spacing", "after", k == 4, F.lit("120"))]
    given = F.filter(F.array(*(F.struct(F.lit(t).cast("string").alias("tag"), F.lit(a).cast("string").alias("attr"), v.cast("string").alias("value"), w.alias("given")) for t, a, w, v in rows)), lambda x: x["given"])
    own = p.select("doc_id", "pos", F.when(F.col("l_suppkey") % 4 > 0, F.col("l_partkey")).alias("style"), F.explode(given).alias("x")).select("doc_id", "pos", "style", "x.tag", "x.attr", "x.value")
    own = formats.families(own, ["doc_id", "pos", "style"], formats.PARAGRAPH | formats.NUMBER)
    docs = p.select("doc_id").distinct()
    level = lambda num, at: [("ind", "left", f"{at * 210 + num}"), ("ind", "hanging", "210")] + [("jc", "val", "right")] * (at == 1)
    levels = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(str(num)).alias("num"), F.lit(at).alias("level"), F.lit(t).alias("tag"), F.lit(a).alias("attr"), F.lit(v).alias("value")) for num in (1, 2) for at in range(3) for t, a, v in level(num, at)))).alias("x")).select("doc_id", "x.*")
    defaults = formats.families(docs.select("doc_id", F.lit("spacing").alias("tag"), F.lit("after").alias("attr"), F.lit("60").alias("value")), ["doc_id"], formats.PARAGRAPH).withColumns({"default_style": F.col("doc_id") * STYLES + 5, "pitch": F.lit(400)})
    out = formats.paragraph_formats(own, _styles(spark, sf_dir), formats.families(levels, ["doc_id", "num", "level"], formats.PARAGRAPH), defaults)
    return out.select("doc_id", "pos", "align", "before", "after", "line", F.round("first", 6).alias("first"), F.round("left", 6).alias("left_side"))


@query(f"""WITH RECURSIVE {_CHAINS}, r AS (
 SELECT o_custkey % 40 AS doc_id, l_orderkey AS pos, l_linenumber AS run, CAST(l_quantity AS INTEGER) % 7 AS n, CASE WHEN l_suppkey % 3 = 0 THEN o_custkey % 40 * 40 + l_linenumber END AS run_style, CASE WHEN l_linenumber % 4 = 1 THEN '30' END AS sz, CASE WHEN l_linenumber = 2 THEN '1' END AS b, o_custkey % 40 * 40 + o_orderkey % 40 AS style
 FROM {ITEMS} JOIN orders ON l_orderkey = o_orderkey
), p AS (SELECT o_custkey % 40 AS doc_id, o_orderkey AS pos, o_custkey % 40 * 40 + o_orderkey % 40 AS style FROM orders), f AS (
 SELECT p.doc_id, p.pos, coalesce(r.run, 0) AS run, coalesce(r.n, 1) AS n, coalesce(r.sz, c.sz, s.sz, '21') AS sz, coalesce(r.b, c.b, s.b) AS b, coalesce(c.eas, s.eas) AS eas, coalesce(c.lat, s.lat, 'Base') AS lat
 FROM p LEFT JOIN (SELECT * FROM r WHERE n > 0) r USING (doc_id, pos) LEFT JOIN s c ON c.style = r.run_style LEFT JOIN s ON s.style = p.style
), v AS (SELECT doc_id, pos, run, n, CASE WHEN eas IS NULL THEN lat WHEN eas.l IS NULL THEN eas.a END AS font, CAST(sz AS INTEGER) / 2 AS size, coalesce(b NOT IN ('0', 'off'), false) AS bold FROM f),
w AS (SELECT doc_id, pos, 'font' AS what, CAST(font AS VARCHAR) AS val, sum(n) AS n, min(run) AS first FROM v WHERE font IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, pos, 'size', CAST(size AS VARCHAR), sum(n), min(run) FROM v GROUP BY ALL UNION ALL SELECT doc_id, pos, 'bold', CAST(bold AS VARCHAR), sum(n), min(run) FROM v GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, what ORDER BY n DESC, first) AS k FROM w)
SELECT doc_id, pos, max(val) FILTER (WHERE what = 'font') AS font, CAST(max(val) FILTER (WHERE what = 'size') AS DOUBLE) AS size, CAST(max(val) FILTER (WHERE what = 'bold') AS BOOLEAN) AS bold FROM t WHERE k = 1 GROUP BY ALL""")
def run_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font, size and weight that most characters of each order have, its line items being runs."""
    o = table(spark, sf_dir, "orders")
    doc = F.col("o_custkey") % STYLES
    paragraphs = o.select(doc.alias("doc_id"), F.col("o_orderkey").alias("pos"), (doc * STYLES + F.col("o_orderkey") % STYLES).alias("style"))
    r = items(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_linenumber")
    one = lambda name, value: F.when(value.isNotNull(), F.struct(value.alias(name)))
    runs = r.select(doc.alias("doc_id"), F.col("l_orderkey").alias("pos"), k.alias("run"), (F.col("l_quantity").cast("int") % 7).alias("n"), F.when(F.col("l_suppkey") % 3 == 0, doc * STYLES + k).alias("run_style"), one("val", F.when(k % 4 == 1, F.lit("30"))).alias("size"), one("val", F.when(k == 2, F.lit("1"))).alias("bold"), F.lit(None).cast("struct<eastAsia:string,eastAsiaTheme:string>").alias("east"), F.lit(None).cast("struct<ascii:string>").alias("latin"))
    attributes = paragraphs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(a).alias("attr"), F.lit(v).alias("value")) for t, a, v in (("sz", "val", "21"), ("rFonts", "ascii", "Base"))))).alias("x")).select("doc_id", "x.*")
    defaults = formats.families(attributes, ["doc_id"], formats.RUN).withColumn("default_style", F.lit(None).cast("long"))
    return formats.run_formats(paragraphs, runs, _styles(spark, sf_dir), defaults)


# Lists: formats, texts, starts and restarts of nine levels.
_FORMATS = ["decimal", "upperRoman", "aiueoFullWidth", "lowerLetter", "decimalEnclosedCircle", "japaneseCounting", "irohaFullWidth", "decimalFullWidth", "lowerRoman"]
_TEXTS = ["第%1条", "%1.%2", "（%3）", "%4)", "%4の%5", "%6", "%7、", "%1-%8", "%9."]
_STARTS, _RESTARTS = [1, 1, 1, 1, 3, 1, 1, 1, 1], [None, None, None, None, None, 2, 0, None, None]
_WIDE = "translate(CAST({n} AS VARCHAR), '0123456789', '０１２３４５６７８９')"
_ROMAN = "['', 'C', 'CC', 'CCC'][{n} // 100 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][{n} // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{n} % 10 + 1]"
_SHOWN = [
    "CAST({n} AS VARCHAR)", _ROMAN, f"CASE WHEN {{n}} <= 46 THEN substr('アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン', {{n}}, 1) ELSE {_WIDE} END",
    "CASE WHEN {n} <= 26 THEN chr(CAST(96 + {n} AS INTEGER)) ELSE CAST({n} AS VARCHAR) END", f"CASE WHEN {{n}} <= 20 THEN substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', {{n}}, 1) ELSE {_WIDE} END",
    "CASE WHEN {n} >= 100 THEN CAST({n} AS VARCHAR) ELSE CASE WHEN {n} >= 20 THEN substr('〇一二三四五六七八九', {n} // 10 + 1, 1) ELSE '' END || CASE WHEN {n} >= 10 THEN '十' ELSE '' END || CASE WHEN {n} % 10 > 0 THEN substr('〇一二三四五六七八九', {n} % 10 + 1, 1) ELSE '' END END",
    f"CASE WHEN {{n}} <= 47 THEN substr('イロハニホヘトチリヌルヲワカヨタレソツネナラムウヰノオクヤマケフコエテアサキユメミシヱヒモセス', {{n}}, 1) ELSE {_WIDE} END", _WIDE, f"lower({_ROMAN})",
]


def _shown(level: int) -> str:
    text = "'" + _TEXTS[level] + "'"
    for k in range(9):
        text = text.replace(f"%{k + 1}", f"' || {_SHOWN[k].format(n=f'CAST(v[{k + 1}] AS BIGINT)')} || '")
    return text


@query(f"""WITH p AS (SELECT l_orderkey // 64 AS doc_id, l_orderkey * 8 + l_linenumber AS pos, 1 + l_suppkey % 3 AS num, CASE WHEN l_suppkey % 3 = 2 THEN 'b' ELSE 'a' END AS list, CASE WHEN l_partkey % 5 = 0 THEN l_suppkey % 9 ELSE l_partkey % 3 END AS level FROM {ITEMS}),
q AS (SELECT *, num = 2 AND level < 2 AND row_number() OVER (PARTITION BY doc_id, num, level ORDER BY pos) = 1 AS anew FROM p),
k AS (SELECT unnest(range(9)) AS k, unnest({[s for s in _STARTS]}) AS start, unnest([0, 1, 2, 3, 4, 2, 0, 7, 8]) AS below),
e AS (SELECT p.doc_id, p.pos, p.list, k.k, max(r.pos) AS since, arg_max(CASE WHEN r.level = k.k THEN CASE WHEN k.k = 0 THEN 5 ELSE 2 END ELSE k.start END, r.pos) AS start FROM p CROSS JOIN k JOIN q r ON r.doc_id = p.doc_id AND r.list = p.list AND r.pos <= p.pos AND (r.level < k.below OR (r.level = k.k AND r.anew)) GROUP BY ALL),
n AS (SELECT p.doc_id, p.pos, p.list, k.k, coalesce(any_value(e.start), k.start) + greatest(count(r.pos) - 1, 0) AS v FROM p CROSS JOIN k LEFT JOIN e ON e.doc_id = p.doc_id AND e.pos = p.pos AND e.k = k.k
 LEFT JOIN p r ON r.doc_id = p.doc_id AND r.list = p.list AND r.level = k.k AND r.pos <= p.pos AND r.pos >= coalesce(e.since, 0) GROUP BY p.doc_id, p.pos, p.list, k.k, k.start),
v AS (SELECT doc_id, pos, list(v ORDER BY k) AS v FROM n GROUP BY ALL)
SELECT doc_id, pos, num, level, CASE level {" ".join(f"WHEN {k} THEN {_shown(k)}" for k in range(9))} END AS label FROM p JOIN v USING (doc_id, pos)""")
def displayed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number shown before each of 64 orders' line items, in two lists of nine levels that three numberings share, with restarts and overrides."""
    k = F.col("l_partkey")
    rows = items(spark, sf_dir).select(F.floor(F.col("l_orderkey") / 64).alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (1 + F.col("l_suppkey") % 3).alias("num"), F.when(k % 5 == 0, F.col("l_suppkey") % 9).otherwise(k % 3).cast("int").alias("level"))
    whole = lambda x: F.lit(x).cast("int")
    defs = F.array(*(F.struct(F.lit(num).cast("long").alias("num"), F.lit("b" if num == 3 else "a").alias("list"), F.lit(k).alias("level"), F.lit(_FORMATS[k]).alias("fmt"), F.lit(_TEXTS[k]).alias("text"), whole(_STARTS[k]).alias("start"), whole(_RESTARTS[k]).alias("restart"), whole({0: 5, 1: 2}.get(k) if num == 2 else None).alias("override")) for num in (1, 2, 3) for k in range(9)))
    levels = rows.select("doc_id").distinct().select("doc_id", F.explode(defs).alias("x")).select("doc_id", "x.*")
    return numbering.labels(rows, levels)


@query("""WITH s AS (SELECT s_suppkey % 10 AS t, s_suppkey, s_suppkey % 40 + 1 AS n FROM supplier), m AS (SELECT s.*, unnest(['chapter', 'article', 'para', 'item', 'sub', 'sub_single', 'sub2']) AS name FROM s),
w AS (SELECT *, translate(CAST(n AS VARCHAR), '0123456789', '０１２３４５６７８９') AS w, substr('アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン', n, 1) AS k, CASE WHEN n >= 20 THEN substr('〇一二三四五六七八九', n // 10 + 1, 1) ELSE '' END || CASE WHEN n >= 10 THEN '十' ELSE '' END || CASE WHEN n % 10 > 0 THEN substr('〇一二三四五六七八九', n % 10 + 1, 1) ELSE '' END AS j FROM m)
SELECT s_suppkey, name, CASE name WHEN 'chapter' THEN CASE WHEN t < 5 THEN '第' || j || '章' ELSE '第' || w || '章' END WHEN 'article' THEN CASE WHEN t = 7 THEN '第' || w || '条' ELSE '第' || n || '条' END WHEN 'para' THEN CASE WHEN t % 2 = 0 THEN w || '　' ELSE n || ' ' END
 WHEN 'item' THEN '(' || n || ')' WHEN 'sub' THEN CASE WHEN t = 3 THEN '・' ELSE k || '　' END WHEN 'sub_single' THEN '' ELSE '（' || k || '）' END AS mark FROM w""")
def template_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ten templates write the number of each level; levels that a template leaves out are written plainly."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("template"), "s_suppkey", (F.col("s_suppkey") % 40 + 1).alias("n"))
    t = F.col("template")
    all_ = s.select("template").distinct()
    # role, ilvl, format, text, what stands behind, where
    given = [
        ("chapter", 0, F.lit("japaneseCounting"), F.lit("第%1章"), F.lit("tab"), t < 5), ("article_title", 1, F.lit("none"), F.lit(""), F.lit("tab"), t == 2), ("article_title", 1, F.lit("decimal"), F.lit("第%2条"), F.lit("tab"), (t != 2) & (t != 7)),
        ("paragraph_1", 2, F.lit("decimal"), F.lit("第%3条"), F.lit("space"), t == 2), ("paragraph_n", 3, F.when(t % 2 == 0, "decimalFullWidth").otherwise("decimal"), F.lit("%4"), F.when(t % 2 == 0, "tab").otherwise("space"), F.lit(True)),
        ("item", 4, F.lit("decimal"), F.lit("(%5)"), F.lit("nothing"), F.lit(True)), ("item_sub_multi", 5, F.lit("none"), F.lit("%4・%6"), F.lit("nothing"), t == 3),
    ]
    rows = all_.select("template", F.explode(F.filter(F.array(*(F.struct(F.lit(r).alias("role"), F.lit("1").alias("num"), F.lit(i).alias("ilvl"), f.alias("fmt"), x.alias("text"), b.alias("behind"), w.alias("given")) for r, i, f, x, b, w in given)), lambda x: x["given"])).alias("x")).select("template", "x.*")
    marks = numbering.template_marks(rows.select("template", "role", "num", "ilvl"), rows.select("template", "num", "ilvl", "fmt", "text", "behind"))
    names = s.select("*", F.explode(F.array(*map(F.lit, numbering.PLAIN))).alias("name")).join(marks, ["template", "name"], "left")
    return names.select("s_suppkey", "name", numbering.mark(F.col("name"), F.col("n"), *(F.col(c) for c in ("fmt", "text", "ilvl", "behind"))).alias("mark"))


def _run_text(flag: Column | str) -> object:
    return F.concat(flag, F.lit("第"), F.col("l_partkey").cast("string"), F.lit("条の"), F.col("l_suppkey").cast("string"))


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS run, l_returnflag || '第' || l_partkey || '条の' || l_suppkey AS text, l_linestatus || l_linenumber AS fmt FROM {ITEMS} WHERE l_partkey % 9 > 0),
a AS (SELECT *, sum(len(text)) OVER (PARTITION BY doc_id ORDER BY run) AS e, e - len(text) AS s FROM r), m AS (SELECT doc_id, max(e) AS whole FROM a GROUP BY 1),
x AS (SELECT l_orderkey AS doc_id, l_suppkey % 37 AS s, l_suppkey % 37 + l_partkey % 50 AS e, 'b' || l_linenumber AS target FROM {ITEMS} UNION ALL SELECT l_orderkey, unnest([0, 5]), unnest([5, 9]), unnest(['c', 'd']) FROM {ITEMS} WHERE l_linenumber = 1),
y AS (SELECT doc_id, s, least(e, whole) AS e, target FROM x JOIN m USING (doc_id) WHERE s < e AND s < whole),
c AS (SELECT DISTINCT doc_id, cut FROM (SELECT doc_id, unnest([s, e]) AS cut FROM a UNION ALL SELECT doc_id, unnest([s, e]) FROM y)), g AS (SELECT doc_id, cut, lead(cut) OVER (PARTITION BY doc_id ORDER BY cut) AS up FROM c)
SELECT g.doc_id, a.run, a.fmt, CAST(g.cut AS INTEGER) AS start, substr(a.text, CAST(g.cut - a.s + 1 AS INTEGER), CAST(g.up - g.cut AS INTEGER)) AS text, coalesce((SELECT string_agg(target, '+' ORDER BY s, -e, target) FROM y WHERE y.doc_id = g.doc_id AND y.s <= g.cut AND g.up <= y.e), '') AS targets FROM g JOIN a ON a.doc_id = g.doc_id AND a.s <= g.cut AND g.up <= a.e""")
def reference_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every order's text cut by references that overlap, touch and reach over several runs."""
    rows = items(spark, sf_dir, together=True)
    n, start = F.col("l_linenumber"), F.col("l_suppkey") % 37
    none = F.lit(None)
    mark = lambda when, run=none, text=none, fmt=none, start=none, end=none, target=none: F.when(when, F.struct(run.cast("int").alias("run"), text.cast("string").alias("text"), fmt.cast("string").alias("fmt"), start.cast("long").alias("start"), end.cast("long").alias("end"), target.cast("string").alias("target")))
    run = mark(F.col("l_partkey") % 9 > 0, run=n, text=_run_text(F.col("l_returnflag")), fmt=F.concat("l_linestatus", n.cast("string")))
    spans = [mark(F.lit(True), start=start, end=start + F.col("l_partkey") % 50, target=F.concat(F.lit("b"), n.cast("string")))]
    spans += [mark(n == 1, start=F.lit(a), end=F.lit(b), target=F.lit(t)) for a, b, t in ((0, 5, "c"), (5, 9, "d"))]
    marks = rows.filter("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(run, *spans)).alias("x")).select("doc_id", "x.*")
    return overlay.pieces_of(marks, ["doc_id"], ["fmt"]).select("doc_id", "run", "fmt", "start", "text", F.array_join("targets", "+").alias("targets"))


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, nth AS pos, o_orderkey % 3 AS k, CASE WHEN o_orderkey % 2 = 0 THEN ' REF _R' || o_orderkey || ' \\n \\h \\* MERGEFORMAT ' WHEN o_orderkey % 5 = 0 THEN ' REF _R' || o_orderkey || ' \\h \\* MERGEFORMAT ' ELSE ' REF _R' || o_orderkey || ' \\n \\h \\* MERGEFORMAT ' END AS w, o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 AS refused FROM {ORDERS}),
p AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS j), q AS (
 SELECT doc_id, pos, k, w, refused, j, CASE WHEN k = 0 THEN [0, 0, 1, 1, 2, NULL][j] ELSE [0, 1, 1, 2, 2, NULL][j] END AS run, CASE WHEN k = 0 THEN ['第', '', '１０条', 'による第１０', '条と第２条', NULL][j] ELSE ['第', '１０条による', '第１０', '条', 'と第２条', NULL][j] END AS text,
  CASE WHEN k = 0 THEN j IN (1, 3) ELSE j IN (3, 4) END AS hit FROM o, p WHERE j < 6)
SELECT doc_id, pos, run, 'f' || run AS fmt, text, CASE WHEN hit THEN w ELSE '' END AS target, refused FROM q WHERE text <> ''""")
def reference_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References put back over two or three runs, at their first, second or last occurrence; those that can't be made to follow a number are told."""
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), F.col("nth").alias("pos"), "o_orderkey", "nth")
    key = F.col("o_orderkey")
    runs = o.select("doc_id", "pos", F.posexplode(F.array(*map(F.lit, ("第", "１０条による第１０", "条と第２条")))).alias("run", "text")).withColumn("fmt", F.concat(F.lit("f"), F.col("run").cast("string")))
    name = F.concat(F.lit("_R"), key.cast("string"))
    fields = o.select("doc_id", "pos", F.lit("第１０条").alias("result"), (key % 3).alias("occ"), F.concat(F.lit(" REF "), name, F.when(key % 2 == 0, F.lit(" \\n")).otherwise(""), F.lit(" \\h ")).alias("instr"), name.alias("bookmark"))
    bookmarks = o.select("doc_id", name.alias("name"), F.lit("第１０条（休日）　前条の休日").alias("para"), F.lit(0).alias("start"), F.when(key % 5 == 0, 3).otherwise(4).alias("end"))
    told = overlay.instructions(fields, bookmarks)
    pieces = overlay.restored(told, runs, carried=["fmt"])
    return pieces.join(told.select("doc_id", "pos", "refused"), ["doc_id", "pos"]).select("doc_id", "pos", "run", "fmt", "text", F.array_join("targets", "+").alias("target"), "refused")
