"""What a formatted document consists of: its paragraphs with their styles, and its table of contents, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Style of each level in the four templates; chapter, article heading, first paragraph, later ones, item.
STYLES = {
    "t1": ("02-第●章", "03-第●条", "04-項", "04-項", "05-(1)号"),
    "t2": ("02-第●章", "03-(条見出し)", "04-第一項", "05-第二項以下", "06-(1)"),
    "t3": ("02-第●章", "03-(条見出し)", "04-第一項", "05-第二項以下", "06-(1)"),
    "t4": ("02-第●章", "03-第●条", "04-1項", "04-2項以降", "05-(1)号"),
}
# End of the fixed values.


_BLANK = r"^[\s\u3000]+|[\s\u3000]+$"


def wrapped(title):
    """A title in one pair of brackets: pairs that stand around all of it go first, a bracket at one end stays."""
    bare = F.regexp_replace(title, _BLANK, "")
    paired = r"(?s)^[（(].*[）)]$"
    opened = F.aggregate(F.sequence(F.lit(1), F.length(bare)), bare, lambda t, _: F.when(t.rlike(paired), F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), _BLANK, "")).otherwise(t))
    bare = F.when(bare.rlike(paired), opened).otherwise(bare)
    return F.when(bare == "", "").otherwise(F.concat(F.lit("（"), bare, F.lit("）")))


def plan(nodes: DataFrame, template: str, key: str = "doc_id") -> DataFrame:
    """key, ord, style, text: a row for each paragraph of the formatted document. nodes as operators.structure.nodes gives them."""
    chapter, article, first, later, item = STYLES[template]
    style = F.when(F.col("type") == "chapter", chapter).when(F.col("type") == "article", article).when((F.col("type") == "paragraph") & (F.col("para_no") == 1), first).when(F.col("type") == "paragraph", later).when(F.col("type").startswith("item"), item).otherwise("Normal")
    indent = F.when((F.col("type") == "paragraph") & F.lit(template == "t3"), "　").otherwise("")
    title = F.coalesce("title", F.lit(""))
    text = F.when(F.col("type") == "chapter", title).when(F.col("type") == "article", wrapped(title)).otherwise(F.concat(indent, F.coalesce("body", F.lit(""))))
    return nodes.select(key, F.col("seq").alias("ord"), style.alias("style"), text.alias("text"))


def contents(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table of contents: chapters and articles."""
    text = F.concat(F.coalesce("number_str", F.lit("")), F.when(F.col("type") == "chapter", F.concat(F.lit("　"), F.coalesce("title", F.lit("")))).otherwise(wrapped(F.coalesce("title", F.lit("")))))
    return nodes.filter(F.col("type").isin("chapter", "article")).select(key, F.col("seq").alias("ord"), F.col("type").alias("level"), text.alias("text"))


def segments(rows: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Texts (key, text) cut at the edges of spans (key, start, end, surface): key, ord, text, marked."""
    at = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    df = rows.join(at, key, "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,end:int>>")))
    edges = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0)), F.flatten(F.transform("s", lambda x: F.array(x["start"], x["end"]))), F.array(F.length("text"))), lambda x: x.isNotNull())))
    df = df.withColumn("e", edges).select(*key, "text", "s", "e", F.posexplode("e").alias("ord", "a")).withColumn("b", F.get("e", F.col("ord") + 1)).filter("b > a")
    return df.select(*key, "ord", F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")).alias("piece"), F.exists("s", lambda x: x["start"] == F.col("a")).alias("marked"))


def counts(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chapters and articles of each document."""
    return nodes.groupBy(key).agg(F.count_if(F.col("type") == "chapter").alias("chapters"), F.count_if(F.col("type") == "article").alias("articles"))
