"""Comments on a document's text as rows: one at the first place of each group of findings, numbered over a corpus, with its text and its part of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import overlay

# How comments are worded.
VARIANT, OTHERS = "【表記ゆれ】この語は文書内で表記がゆれています。", "… 他に"
NOUNS_ONLY = "※ 送り仮名は名詞用法だけを対象にしています（「申し出る」などの動詞は除外）。"
ONCE = "※ このコメントはゆれ1件につき初出の1箇所だけに付けています。該当箇所は文書全体で青字にしています（自動修正なし）。"
SURE, LIKELY = ("【用語の誤用】", "の誤りと思われます。"), ("【用語の確認】", "が適切かもしれません。")
UNTOUCHED = "※ 自動修正はしていません。ご確認ください。"
AUTHOR, DATE = "整形ツール", "2000-01-01T00:00:00Z"
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
# End of the fixed values.


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """rows with a dense number from 0 in an order over all of them: tasks number their own rows of a sort by ranges, and sums of the tasks' counts tell what stands before each."""
    placed = written(rows.orderBy(*order).select(*rows.columns, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("nth")), "numbered")
    counts = placed.groupBy("task").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = counts.select(F.col("task").alias("of"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return placed.join(F.broadcast(starts), F.col("task") == F.col("of")).select(*rows.columns, (F.col("ahead") + F.col("nth") - F.col("first")).alias(name))


def ranges(spans: DataFrame, runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """comment_id, key, pos, group, surface, from_piece, to_piece: a comment at the first of a document's spans (key, pos, start, end, group, surface) of each group.

    The runs (key, pos, run, text) of its paragraphs are cut at the comments' ends; pieces are counted from 0 in each paragraph. comment_id is dense over all
    documents, by key, pos, start and group. Spans that reach beyond the text end with it; those outside it have no comment.
    """
    first = Window.partitionBy(key, "group").orderBy("pos", "start", "end", "surface")
    whole = runs.groupBy(key, "pos").agg(F.sum(F.length("text")).cast("int").alias("length"))
    inside = spans.join(whole, [key, "pos"]).withColumn("end", F.least("end", "length")).filter((F.col("start") >= 0) & (F.col("start") < F.col("end"))).drop("length")
    chosen = numbered(inside.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k"), [key, "pos", "start", "group"], "comment_id")
    cut = overlay.pieces(runs, chosen.select(key, "pos", "start", "end", F.col("group").cast("string").alias("target")), [key, "pos"], [])
    cut = cut.select(key, "pos", "start", "end", (F.row_number().over(Window.partitionBy(key, "pos").orderBy("start")) - 1).alias("piece"))
    out = chosen.join(cut.select(key, "pos", "start", F.col("piece").alias("from_piece")), [key, "pos", "start"]).join(cut.select(key, "pos", "end", F.col("piece").alias("to_piece")), [key, "pos", "end"])
    return out.select("comment_id", key, "pos", "group", "surface", "from_piece", "to_piece")


def label(counts: Column) -> Column:
    """The forms of a group and how often each is there, from array<struct<form, n>>."""
    return F.array_join(F.transform(F.filter(counts, lambda x: x["n"] > 0), lambda x: F.concat(x["form"], F.lit(" "), x["n"].cast("string"), F.lit("件"))), "／")


def text(surface: Column, category: Column, counts: Column, correct: Column, sure: Column) -> Column:
    """What a comment says of one spelling: which others are there, or which word is meant (correct isn't null)."""
    quoted = lambda c: F.concat(F.lit("「"), c, F.lit("」"))
    others = F.filter(counts, lambda x: (x["form"] != surface) & (x["n"] > 0))
    listed = F.when(F.size(others) > 0, F.concat(F.lit(OTHERS), quoted(F.array_join(F.transform(others, lambda x: x["form"]), "」「")))).otherwise("")
    variant = F.concat_ws("\n", F.lit(VARIANT), F.concat(F.lit("・"), quoted(surface), listed, F.lit("（"), label(counts), F.lit("）")), F.when(category == "送り仮名", F.lit(NOUNS_ONLY)), F.lit(ONCE))
    misuse = F.concat_ws("\n", F.concat(F.when(sure, SURE[0]).otherwise(LIKELY[0]), quoted(surface), F.lit("は"), quoted(correct), F.when(sure, SURE[1]).otherwise(LIKELY[1])), F.lit(UNTOUCHED))
    return F.when(correct.isNull(), variant).otherwise(misuse)


def part(comments: DataFrame, key: str = "doc_id", author: str = AUTHOR) -> DataFrame:
    """key, xml: the comments part of each document, from comments (key, nth: its number in the document, text)."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(safe, "\n"), lambda x: F.concat(F.lit('<w:r><w:t xml:space="preserve">'), x, F.lit("</w:t></w:r>"))), "<w:r><w:br/></w:r>")
    one = F.concat(F.lit('<w:comment w:id="'), F.col("nth").cast("string"), F.lit(f'" w:author="{author}" w:date="{DATE}" w:initials="{author[:2]}"><w:p>'), lines, F.lit("</w:p></w:comment>"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", one.alias("x")))), lambda c: c["x"]), "")
    return comments.groupBy(key).agg(F.concat(F.lit(f'<w:comments xmlns:w="{NAMESPACE}">'), whole, F.lit("</w:comments>")).alias("xml"))
