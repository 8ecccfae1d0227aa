"""Tables and drawings on the nodes of a document, and back on its paragraphs after these have been made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What can hold a table or drawing, outermost first; what hangs on them.
NODES, HUNG = ("chapter", "article", "paragraph", "item", "sub", "sub2"), ("table", "drawing")


def attached(blocks: DataFrame, key: str = "doc_id", begin: str | None = None) -> DataFrame:
    """key, pos, kind, index, holder, at, made: where each table and drawing of blocks (key, pos, kind) hangs.

    It hangs on the node that is open at its place and deepest: the last one before it. An article without paragraphs gets an empty first one (made), which
    holds all that comes before the next node; before any node, or before the position in column begin, it belongs to the front (holder front, no at). index counts tables
    and drawings of a document apart, the front's too. Positions are unique within key.
    """
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = F.col("pos") >= F.col(begin) if begin else F.lit(True)
    node = F.when(F.col("kind").isin(*NODES) & F.coalesce(body, F.lit(True)), F.struct(F.col("kind").alias("holder"), F.col("pos").alias("at")))
    rows = blocks.withColumn("open", F.last(node, True).over(order))
    rows = rows.filter(F.col("kind").isin(*HUNG)).withColumn("index", F.row_number().over(Window.partitionBy(key, "kind").orderBy("pos")) - 1)
    made = F.coalesce(F.col("open.holder") == "article", F.lit(False))
    return rows.select(key, "pos", "kind", "index", F.when(made, "paragraph").otherwise(F.coalesce("open.holder", F.lit("front"))).alias("holder"), F.col("open.at").alias("at"), made.alias("made"))


def restored(tables: DataFrame, paragraphs: DataFrame, key: list[str]) -> DataFrame:
    """tables (key, paragraph: the old paragraph's place in its article from 0, further columns) with to: the place among the article's new paragraphs (key, a row each), the same or the last; null if there are none."""
    n = paragraphs.groupBy(*key).agg(F.count("*").alias("n"))
    return tables.join(n, key, "left").withColumn("to", F.when(F.col("n") > 0, F.least(F.col("paragraph"), F.col("n") - 1))).select(*tables.columns, "to")


def hung(nodes: DataFrame, found: DataFrame, contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """nodes (key, pos, ...) with tables and drawings, arrays of what contents (key, pos, content) have for each of found, in order; a node that was made for them is added."""
    held = found.join(contents.select(key, "pos", "content"), [key, "pos"]).filter("at is not null")
    some = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("index", "content")))), lambda x: x["content"])
    lists = held.groupBy(key, "at", "made").agg(some("table").alias("tables"), some("drawing").alias("drawings"))
    none = F.array().cast("array<string>")
    own = nodes.join(lists.filter("not made").select(key, F.col("at").alias("pos"), "tables", "drawings"), [key, "pos"], "left").withColumns({"tables": F.coalesce("tables", none), "drawings": F.coalesce("drawings", none)})
    new = lists.filter("made").select(key, F.col("at").alias("pos"), F.lit("paragraph").alias("kind"), "tables", "drawings")
    return own.unionByName(new, allowMissingColumns=True)
