"""What goes to a model and what may come back: chunks of lines with their context, and rules that hold answers to the document. No model is called."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import editing

CHUNK_CHARS, CONTEXT_LINES = 30_000, 3
KINDS = ("chapter", "article", "article_title", "paragraph", "item", "item_sub", "text")
_FENCE = re.compile("^```[A-Za-z]*\\s*(.*?)\\s*```$", re.S)


def chunks(lines: DataFrame, key: str = "doc_id", chars: int = CHUNK_CHARS) -> DataFrame:
    """lines (key, pos, line, target) with chunk, of those chunks that hold a target. A chunk is closed before the line that would not fit.

    Filling is a fold, so it runs over one document's line lengths with aggregate().
    """
    size = F.length(F.concat(F.col("pos").cast("string"), F.lit(": "), F.regexp_replace("line", "[\\r\\n]", " "))) + 1
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", size.alias("n"), "line", "target"))).alias("l"))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("filled"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["filled"] > 0) & (a["filled"] + x["n"] > chars)
        chunk = a["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, x["n"]).otherwise(a["filled"] + x["n"]).alias("filled"), F.array_append(a["out"], chunk).alias("out"))

    rows = rows.withColumn("c", F.aggregate("l", zero, step, lambda a: a["out"]))
    each = rows.select(key, F.explode(F.arrays_zip("l", "c")).alias("z")).select(key, "z.l.pos", "z.l.line", "z.l.target", F.col("z.c").alias("chunk"))
    return each.withColumn("any", F.bool_or("target").over(Window.partitionBy(key, "chunk"))).filter("any").drop("any")


def prompts(chunked: DataFrame, lines: DataFrame, key: str = "doc_id", context: int = CONTEXT_LINES) -> DataFrame:
    """key, chunk, body: each chunk's lines, numbered, targets starred, with lines of context on either side."""
    edges = chunked.groupBy(key, "chunk").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    rows = lines.join(edges, key).filter((F.col("pos") >= F.col("a") - context) & (F.col("pos") <= F.col("b") + context))
    star = F.when(F.col("target") & (F.col("pos") >= F.col("a")) & (F.col("pos") <= F.col("b")), "*").otherwise("")
    text = F.concat(star, F.col("pos").cast("string"), F.lit(": "), F.regexp_replace("line", "[\\r\\n]", " "))
    return rows.groupBy(key, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "\n").alias("body"))


def objects(text: str | None) -> list:
    """JSON values in an answer, fenced or among other words."""
    text = (text or "").strip()
    if m := _FENCE.match(text):
        text = m[1]
    try:
        return [json.loads(text)]
    except ValueError:
        out, at, decoder = [], text.find("{"), json.JSONDecoder()
        while at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
                out.append(value)
                at = text.find("{", end)
            except ValueError:
                at = text.find("{", at + 1)
        return out


def labels(text: str | None, expected: set[int]) -> dict[int, str] | None:
    """Kinds by line number; None unless exactly the expected lines have a known kind each."""
    found = next((o["labels"] for o in objects(text) if isinstance(o, dict) and "labels" in o), None)
    if not isinstance(found, dict) or not all(isinstance(k, str) and k.strip().isdigit() and v in KINDS for k, v in found.items()):
        return None
    out = {int(k): v for k, v in found.items()}
    return out if len(out) == len(found) and set(out) == expected else None


def paragraphs(answer: object) -> list[dict] | None:
    """An answer's paragraphs if each has a body."""
    some = answer.get("paragraphs") if isinstance(answer, dict) else None
    good = isinstance(some, list) and some and all(isinstance(p, dict) and isinstance(p.get("body"), str) for p in some)
    return some if good else None


def bodies(paras: list[dict]) -> list[str]:
    """All text of paragraphs, in order."""
    out = []
    for p in paras:
        out.append(p.get("body") or "")
        for key in ("items", "sub_items", "sub_items2"):
            out += bodies(p.get(key) or [])
    return out


def adopt(article: dict, answer: object) -> dict | None:
    """The article with an answer's paragraphs; None if it has figures, or the answer changes no structure or the text."""
    new = paragraphs(answer)

    def figured(nodes: list[dict]) -> bool:
        return any(n.get("tables") or n.get("drawings") or figured([k for key in ("items", "sub_items", "sub_items2") for k in n.get(key) or []]) for n in nodes)

    if new is None or figured([article, *article["paragraphs"]]):
        return None
    changed = article | {"paragraphs": new}
    if editing.signature(changed, True) == editing.signature(article, True) or not editing.restructured(bodies(article["paragraphs"]), bodies(new)):
        return None
    return changed | {"_ai_restructured": True}


def classified(lines: DataFrame, classifier: Callable[[pd.Series], pd.Series], text: str = "line") -> DataFrame:
    """lines with the kind that a classifier, any function from texts to KINDS, gives; an unknown answer is null."""

    @F.pandas_udf("string")
    def kind(batch: pd.Series) -> pd.Series:
        return classifier(batch).where(lambda s: s.isin(KINDS), None)

    return lines.withColumn("kind", kind(text))
