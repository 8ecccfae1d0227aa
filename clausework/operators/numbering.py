"""The numbers that a word processor shows before paragraphs, and how a template writes them.

A list's counters are running counts over its paragraphs: of nine levels each has its count so far and, of the last paragraph that
set it back, the count up to there. Both are windows over one sort of the list; lists are told apart by their definition, which several numberings may share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

LEVELS = 9
# Sequences, what stands for each level without a template, and behind a number.
PLAIN = {"chapter": "第{}章", "article": "第{}条", "para": "{}　", "item": "（{}）", "sub": "{}　", "sub_single": "", "sub2": "（{}）"}
BEHIND = {"tab": "　", "space": " ", "nothing": ""}
IROHA = "イロハニホヘトチリヌルヲワカヨタレソツネナラムウヰノオクヤマケフコエテアサキユメミシヱヒモセス"
OLD_KANA = {"ヰ": "ｲ", "ヱ": "ｴ"}
ROLES = [("chapter", "chapter"), ("para", "paragraph_n"), ("item", "item"), ("sub", "item_sub_multi"), ("sub_single", "item_sub_single"), ("sub2", "item_sub2"), ("article", "article_title"), ("article", "paragraph_1")]
# End of the fixed values.
_ROMAN = (["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])
_HALF = dict(zip(X.GOJUON, X.HALF_KANA, strict=True)) | OLD_KANA
_SEQUENCES = {"decimalEnclosedCircle": X.CIRCLED[:20], "aiueoFullWidth": list(X.GOJUON), "irohaFullWidth": list(IROHA), "aiueo": list(X.HALF_KANA), "iroha": [_HALF[c] for c in IROHA]}


def _nth(values: list[str], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def styled(fmt: Column, n: Column) -> Column:
    """n as a numbering format writes it; beyond a sequence, full-width digits, beyond letters, plain ones."""
    digit = lambda d: F.floor(n / d) % 10
    roman = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *(_nth(t, digit(d)) for t, d in zip(_ROMAN, (100, 10, 1), strict=True)))
    out = F.when(fmt.isin("none", "bullet"), F.lit("")).when(fmt.isin("decimalFullWidth", "decimalFullWidth2"), T.wide(n))
    for name, values in _SEQUENCES.items():
        out = out.when(fmt == name, F.when((n >= 1) & (n <= len(values)), _nth(values, n - 1)).otherwise(T.wide(n)))
    kanji = F.when(n == 0, F.lit("〇")).when(n < 100, T.kanji_numeral(n)).otherwise(n.cast("string"))
    out = out.when(fmt.isin("japaneseCounting", "ideographTraditional", "japaneseDigitalTenThousand"), kanji)
    for name, first in (("upperLetter", 64), ("lowerLetter", 96)):
        out = out.when(fmt == name, F.when((n >= 1) & (n <= 26), F.char((n + first).cast("int"))).otherwise(n.cast("string")))
    return out.when(fmt == "upperRoman", roman).when(fmt == "lowerRoman", F.lower(roman)).otherwise(n.cast("string"))


def labels(paragraphs: DataFrame, levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs (key, pos, num, level) with label, null without a definition.

    levels: key, num, list (the definition that numberings share), level from 0, fmt, text (%1 to %9 for the levels' numbers), start,
    restart (the level starts again behind one below this; null: behind any higher one; 0: never), override (where the numbering starts the list again).
    """
    of_num = levels.groupBy(key, "num").agg(F.first("list").alias("list"), F.map_from_entries(F.collect_list(F.struct("level", F.struct("fmt", "text", "start", "restart", "override")))).alias("defs"))
    rows = paragraphs.join(of_num, [key, "num"], "left")
    so_far = Window.partitionBy(key, "list").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(key, "list", "num", "level").orderBy("pos")
    rows = rows.withColumn("opens", F.row_number().over(own) == 1).withColumns({f"n{k}": F.count_if(F.col("level") == k).over(so_far) for k in range(LEVELS)})
    back = {}
    for k in range(LEVELS):
        d = F.col("defs")[k]
        higher = F.col("level") < F.coalesce(d["restart"], F.lit(k))
        again = (F.col("level") == k) & F.col("opens") & d["override"].isNotNull()
        back[f"b{k}"] = F.last(F.when(again, F.struct((F.col(f"n{k}") - 1).alias("at"), d["override"].alias("start"))).when(higher, F.struct(F.col(f"n{k}").alias("at"), d["start"].alias("start"))), True).over(so_far)
    rows = rows.withColumns(back)
    shown = lambda k: F.struct(F.lit(f"%{k + 1}").alias("place"), F.col("defs")[k]["fmt"].alias("fmt"), (F.coalesce(F.col(f"b{k}.start"), F.col("defs")[k]["start"], F.lit(1)) + F.greatest(F.col(f"n{k}") - F.coalesce(F.col(f"b{k}.at"), F.lit(0)) - 1, F.lit(0))).alias("n"))
    text = F.col("defs")[F.col("level")]["text"]
    label = F.aggregate(F.array(*map(shown, range(LEVELS))), text, lambda s, x: F.replace(s, x["place"], F.coalesce(styled(x["fmt"], x["n"]), F.lit(""))))
    return rows.select(*paragraphs.columns, label.alias("label"))


def template_marks(roles: DataFrame, levels: DataFrame, key: str = "template") -> DataFrame:
    """key, name (chapter, article, para, ...), fmt, text, ilvl, behind: how a template writes each level's number.

    roles: key, role, num, ilvl. levels: key, num, ilvl, fmt, text, behind. Articles are numbered at their heading or, if that has no 条, at their first paragraph.
    """
    known = roles.sparkSession.createDataFrame([(r, n, k) for k, (n, r) in enumerate(ROLES)], "role string, name string, rank int")
    found = roles.join(F.broadcast(known), "role").join(levels, [key, "num", "ilvl"])  # eight roles
    found = found.filter((F.col("name") != "article") | F.col("text").contains("条"))
    best = Window.partitionBy(key, "name").orderBy("rank")
    return found.withColumn("k", F.row_number().over(best)).filter("k = 1").select(key, "name", F.coalesce("fmt", F.lit("decimal")).alias("fmt"), F.coalesce("text", F.lit("")).alias("text"), "ilvl", F.coalesce("behind", F.lit("tab")).alias("behind"))


def mark(name: Column, n: Column, fmt: Column, text: Column, ilvl: Column, behind: Column) -> Column:
    """A level's number as its template writes it, without the numbers of other levels; where text is null, as it is written without a template."""
    own = F.regexp_replace(F.replace(text, F.concat(F.lit("%"), (ilvl + 1).cast("string")), styled(fmt, n)), "%[1-9]", "")
    gap = F.when(name.isin("chapter", "article"), F.lit(""))
    for k, v in BEHIND.items():
        gap = gap.when(behind == k, F.lit(v))
    kana = F.when((n >= 1) & (n <= len(X.GOJUON)), _nth(list(X.GOJUON), n - 1)).otherwise(T.wide(n))
    plain = F.lit("")
    for k, v in PLAIN.items():
        plain = F.when(name == k, F.replace(F.lit(v), F.lit("{}"), F.when(name.isin("sub", "sub2"), kana).otherwise(T.wide(n)))).otherwise(plain)
    return F.when(text.isNull(), plain).otherwise(F.concat(own, gap.otherwise("　")))
