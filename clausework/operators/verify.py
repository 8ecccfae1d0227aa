"""Whether text was lost, added or repeated between a source and an output."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..sources.shared import written
from . import containment

# Signs before a text that don't count.
_SIGNS = re.compile("^[\\s　]*[①-⑳㉑-㉟㊱-㊿ⓐ-ⓩⅰ-ⅹⅠ-Ⅹ]+[\\s　]*")
_NUMBERS = re.compile(
    "^(?:第[0-9一二三四五六七八九十百千]+(?:条|章|節|款|編|項|号)(?:の[0-9]+)?|[0-9]{1,3}(?:[.)、,:：]|(?=\\s))|\\([0-9]{1,3}\\)|\\([一二三四五六七八九十]{1,3}\\)"
    "|[ア-ヶ][.)、]|\\([ア-ヶ]\\)|[a-zA-Z][.)]|\\([a-zA-Z]\\)|[ivxIVX]{1,4}[.)]|[一二三四五六七八九十]{1,3}[、.])\\s*"
)
LEAST_PART = 8


def _peeled(pattern: re.Pattern, s: str, strip: bool = False) -> str:
    for _ in range(3):
        s = pattern.sub("", s.lstrip() if strip else s, count=1)
    return s


def normal(s: str | None) -> str:
    """A text as it is compared: compatibility forms, up to three nested signs or numbers gone from its front, no blanks."""
    s = unicodedata.normalize("NFKC", _peeled(_SIGNS, s or ""))
    return re.sub("[\\s　​]+", "", _peeled(_NUMBERS, s, True)).replace("｢", "「").replace("｣", "」")


@F.pandas_udf(StringType())
def normalized(s: pd.Series) -> pd.Series:
    return s.map(normal)


def sentences(rows: DataFrame, text: str = "line") -> DataFrame:
    """rows with norm, less those of which nothing is compared."""
    return rows.withColumn("norm", normalized(F.col(text))).filter("norm <> ''")


def absent(rows: DataFrame, others: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, pos, norm) whose text is nowhere in the other side's texts put together; an empty text is missing nowhere. Equal texts are settled by a join, the others by an index of grams."""
    rest = rows.filter("norm <> ''").join(others.select(key, "norm").distinct(), [key, "norm"], "left_anti")
    big = containment.large(others.select(key, F.col("norm").alias("text")), key)

    def direct(rest: DataFrame, others: DataFrame) -> DataFrame:
        whole = others.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), "").alias("whole"))
        return rest.join(whole, key, "left").filter(~F.coalesce(F.contains("whole", "norm"), F.lit(False))).select(*rows.columns)

    if big.isEmpty():
        return direct(rest, others)
    far = written(rest.join(big, key, "left_semi").withColumn("pid", containment.named(F.col("norm"))), "absent")
    found = containment.indexed(far.select(key, "pid", "norm").distinct(), containment.joined(others.join(big, key, "left_semi"), key), key).select(key, "pid").distinct()
    return direct(rest.join(big, key, "left_anti"), others.join(big, key, "left_anti")).unionByName(far.join(found, [key, "pid"], "left_anti").select(*rows.columns))


def repeated(src: DataFrame, out: DataFrame, key: str = "doc_id", least: int = LEAST_PART) -> DataFrame:
    """Texts (key, norm) that the output has more often than the source, which has them."""
    count = lambda df, name: df.filter(F.length("norm") >= least).groupBy(key, "norm").agg(F.count("*").alias(name))
    return count(src, "n_src").join(count(out, "n_out"), [key, "norm"]).filter("n_out > n_src")


def totals(src: DataFrame, out: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs and characters of either side."""
    count = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"{p}_paragraphs"), F.sum(F.length("norm")).alias(f"{p}_chars"))
    return count(src, "src").join(count(out, "out"), key, "full").na.fill(0)


def attributed(rows: DataFrame, base: DataFrame, edited: DataFrame, key: str = "doc_id") -> DataFrame:
    """Missing rows (key, norm) with by_edit: whether editing took the text away.

    It did if a text of base that isn't in edited is the row's, or one holds the other in at least LEAST_PART characters, and
    nothing in edited holds the row's text.
    """
    gone = written(base.select(key, "norm").distinct().join(edited.select(key, "norm").distinct(), [key, "norm"], "left_anti"), "gone")
    mine = written(containment.patterns(rows, key), "missing")
    equal = mine.join(gone, [key, "norm"], "left_semi").select(key, "pid")
    inside = containment.find(mine.filter(F.length("norm") >= LEAST_PART), containment.each(gone, key), key).select(key, "pid")
    around = containment.find(containment.patterns(gone, key, LEAST_PART), containment.each(rows, key), key).select(key, F.col("tid").alias("pid"))
    kept = containment.find(mine, containment.each(edited, key), key).select(key, "pid").distinct()
    hit = equal.unionByName(inside).unionByName(around).distinct().join(kept, [key, "pid"], "left_anti").withColumn("by_edit", F.lit(True))
    return rows.withColumn("pid", containment.named(F.col("norm"))).join(hit, [key, "pid"], "left").select(*rows.columns, F.coalesce("by_edit", F.lit(False)).alias("by_edit"))


# Hints begin with an article's number.
HINT = "^第[　\\s]*[０-９0-9〇一二三四五六七八九十百千万]+[　\\s]*条"


def attached(hints: DataFrame, paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, hint: each hint (key, hint) at the first of paragraphs (key, pos, text: a row for each of its units) of which a unit holds it, blanks aside.

    Hints that don't begin with an article's number, and those that no paragraph holds, are dropped; of hints that say the same the shortest is kept.
    """
    bare = lambda c: F.regexp_replace(c, "[　\\s]", "")
    said = hints.select(key, F.regexp_replace("hint", "^[　\\s]+|[　\\s]+$", "").alias("hint")).filter(F.col("hint").rlike(HINT)).withColumn("norm", bare(F.col("hint")))
    units = paragraphs.select(key, "pos", bare(F.col("text")).alias("norm")).filter("norm <> ''")
    found = containment.find(containment.patterns(said, key), containment.each(units, key), key)
    first = found.join(units.select(key, "pos", containment.named(F.col("norm")).alias("tid")), [key, "tid"]).groupBy(key, "pid").agg(F.min("pos").alias("pos"))
    kept = said.groupBy(key, containment.named(F.col("norm")).alias("pid")).agg(F.min(F.struct(F.length("hint").alias("n"), "hint"))["hint"].alias("hint"))
    return kept.join(first, [key, "pid"]).select(key, "pos", "hint")


def bare_title(c: Column) -> Column:
    return T.without_head_label(c)


def report(found: DataFrame, key: str = "doc_id", top: int = 5) -> DataFrame:
    """A markdown report of each document: found has key, section, ord and text; a section lists its first `top`, then how many more."""
    listed = found.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    rest = F.size("t") - top
    body = F.concat_ws("\n", F.concat(F.lit("## "), "section", F.lit("（"), F.size("t").cast("string"), F.lit("件）")), F.concat_ws("\n", F.transform(F.slice("t", 1, top), lambda x: F.concat(F.lit("- "), x["text"]))), F.when(rest > 0, F.concat(F.lit("- …他"), rest.cast("string"), F.lit("件"))))
    return listed.withColumn("s", body).groupBy(key).agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("section", "s"))), lambda x: x["s"])).alias("report"))
