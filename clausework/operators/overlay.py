"""References put back into formatted paragraphs, as rows: runs of text are cut where references begin and end, and each piece has its run's format and its references' targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters to a bucket of places: as many as a long has bits.
BUCKET = 64
# Instructions of reference fields and what they show.
BY_NUMBER, HEAD = "(?i)\\\\[nrw]\\b", "(?i)^(\\s*REF\\s+\\S+)"
ARTICLE = "^第[0-9０-９一二三四五六七八九十百千]+条"
KEEP_FORMAT = " \\* MERGEFORMAT "
# End of the fixed values.


def pieces(runs: DataFrame, spans: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """key, run, carried, start, end, text, targets: runs (key, run, text, carried) cut at the ends of spans (key, start, end, target).

    targets are those of the spans that cover the piece, outermost first, or none. Spans may overlap, touch and reach over runs; empty runs and spans
    have no piece.
    """
    both = runs.select(*key, "run", "text", *carried).unionByName(spans.select(*key, "start", "end", "target").dropna(subset=key), allowMissingColumns=True)
    return pieces_of(both, key, carried)


def pieces_of(marks: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """What pieces() returns, of runs and spans in one table (key, run, text, carried, start, end, target); spans are the rows without text.

    All steps are by paragraph, so rows that are dealt out by key are shuffled no more, and others once. Cuts are bits of a bucket of places, and a span goes,
    bucket by bucket, to the pieces that begin below it, so no row holds a paragraph's references.
    """
    is_run = F.col("text").isNotNull()
    marks = marks.select(*key, "run", "text", F.struct(*carried).alias("of"), "start", "end", "target").filter((F.length("text") > 0) | (~is_run & (F.col("start") < F.col("end"))))
    reached = F.sum(F.length("text")).over(Window.partitionBy(*key).orderBy(~is_run, "run").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = marks.withColumn("reached", reached).withColumn("from", F.when(is_run, F.col("reached") - F.length("text")).otherwise(F.greatest("start", F.lit(0)))).withColumn("to", F.when(is_run, F.col("reached")).otherwise(F.least("end", "reached")))
    at = at.filter(F.col("reached").isNotNull() & (F.col("from") < F.col("to"))).select(*key, "run", "text", "of", "target", F.col("from").cast("int"), F.col("to").cast("int"))
    bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
    bit = lambda c: F.when(F.col("bucket") == bucket(c), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c) % BUCKET)).otherwise(F.lit(0))
    at = at.withColumn("bucket", F.explode(F.sequence(bucket("from"), F.when(is_run, bucket("from")).otherwise(bucket("to")))))
    cuts = F.bit_or(bit("from").bitwiseOR(F.when(is_run, F.lit(0)).otherwise(bit("to")))).over(Window.partitionBy(*key, "bucket"))
    first = F.col("bucket") * BUCKET
    places = F.sequence(F.greatest("from", first), F.when(is_run, F.col("from")).otherwise(F.least("to", first + BUCKET - 1)))
    at = at.withColumn("cuts", cuts).withColumn("start", F.explode(places)).filter(F.getbit("cuts", F.col("start") % BUCKET) == 1)
    covers = F.when(~is_run & (F.col("start") < F.col("to")), F.struct("from", (-F.col("to")).alias("to"), "target"))
    at = at.groupBy(*key, "start").agg(F.first(F.when(is_run, F.struct("run", "from", "to", "text", "of")), True).alias("r"), F.collect_list(covers).alias("over"))
    order = Window.partitionBy(*key).orderBy("start")
    cut = at.select(*key, "start", F.last("r", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("r"), F.lead("start").over(order).alias("next"), "over")
    cut = cut.withColumn("end", F.least("next", "r.to")).filter(F.col("start") < F.col("end"))
    text = F.substring(F.col("r.text"), F.col("start") - F.col("r.from") + 1, F.col("end") - F.col("start"))
    return cut.select(*key, "r.run", *(F.col(f"r.of.{c}").alias(c) for c in carried), "start", "end", text.alias("text"), F.transform(F.sort_array("over"), lambda x: x["target"]).alias("targets"))


def shown_at(text: Column, result: Column, nth: Column) -> Column:
    """Where the nth (from 0) occurrence of a result stands in a text, from 0; where there are fewer, the last; null if there is none."""
    there = F.floor((F.length(text) - F.length(F.replace(text, result, F.lit("")))) / F.length(result))
    ahead = F.call_function("substring_index", text, result, (F.least(nth, there - 1) + 1).cast("int"))
    return F.when((F.length(result) > 0) & (there > 0), F.length(ahead))


def instructions(fields: DataFrame, bookmarks: DataFrame, key: str = "doc_id") -> DataFrame:
    """fields (key, ord, para, result, instr, bookmark) with their instruction to be written and refused, whether a typed article number couldn't be made one that follows.

    A reference that shows the article number which its bookmark (key, name, para, start, end) encloses at a paragraph's head is made to show
    the paragraph's number, since formatting replaces typed numbers. All keep their format when they are brought up to date.
    """
    marks = bookmarks.select(key, F.col("name").alias("bookmark"), T.reference_norm(F.substring(F.col("para"), F.col("start") + 1, F.col("end") - F.col("start"))).alias("enclosed"), T.reference_norm(F.left("para", F.col("start"))).alias("ahead"))
    rows = fields.join(marks, [key, "bookmark"], "left")
    result = T.reference_norm(F.col("result"))
    typed = F.col("enclosed").isNotNull() & ~F.col("instr").rlike(BY_NUMBER) & F.col("result").rlike(ARTICLE) & F.col("instr").rlike(HEAD)
    fit = (F.col("ahead") == "") & result.rlike(ARTICLE + "$") & (F.col("enclosed") == result)
    instr = F.when(typed & fit, F.regexp_replace("instr", HEAD, "$1 \\\\n")).otherwise(F.col("instr"))
    kept = F.when(F.upper(instr).contains("MERGEFORMAT"), instr).otherwise(F.concat(F.rtrim(instr), F.lit(KEEP_FORMAT)))
    return rows.select(*fields.columns, kept.alias("written"), F.coalesce(typed & ~fit, F.lit(False)).alias("refused"))


def restored(fields: DataFrame, runs: DataFrame, key: str = "doc_id", carried: list[str] | None = None) -> DataFrame:
    """Pieces of the runs (key, pos, run, text, carried) of formatted paragraphs with what is shown by fields (key, pos, result, occ, written), pos being the paragraph that was found for the field."""
    order = Window.partitionBy(key, "pos").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = runs.join(fields.select(key, "pos").distinct(), [key, "pos"], "left_semi").withColumn("whole", F.array_join(F.collect_list("text").over(order), "")).filter("run = 0").select(key, "pos", "whole")
    spans = fields.join(whole, [key, "pos"]).withColumn("start", shown_at(F.col("whole"), F.col("result"), F.col("occ")))
    spans = spans.filter("start IS NOT NULL").select(key, "pos", "start", (F.col("start") + F.length("result")).alias("end"), F.col("written").alias("target"))
    return pieces(runs, spans, [key, "pos"], carried or [])
