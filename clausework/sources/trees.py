"""Trees as JSON: read with a known schema, checked before they are written, and the files that formatting yields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import validate
from . import docx

_FIGURE = "struct<type:string,index:int,text:string,name:string,mime:string,data:string,before:string,num:string,den:string,after:string>"
_TABLE = "struct<type:string,index:int,rows:array<array<string>>>"
_HANGS = f"tables:array<{_TABLE}>,drawings:array<{_FIGURE}>,_review_hint:array<string>"
_SUB2 = f"struct<type:string,number:bigint,body:string,mark:string,{_HANGS}>"
_SUB = f"struct<type:string,number:bigint,body:string,mark:string,level:string,sub_items2:array<{_SUB2}>,{_HANGS}>"
_ITEM = f"struct<type:string,number:bigint,body:string,mark:string,sub_items:array<{_SUB}>,{_HANGS}>"
_PARAGRAPH = f"struct<type:string,number:bigint,body:string,mark:string,items:array<{_ITEM}>,_article_hint:array<string>,{_HANGS}>"
_ARTICLE = f"struct<type:string,number:bigint,branch:bigint,number_str:string,title:string,title_note:string,lead:array<string>,paragraphs:array<{_PARAGRAPH}>,{_HANGS}>"
#: A tree: its depth is fixed, so no type refers to itself.
TREE = f"array<struct<type:string,number:bigint,branch:bigint,number_str:string,title:string,title_note:string,body:string,texts:array<string>,indices:array<int>,preamble:array<string>,lead:array<string>,articles:array<{_ARTICLE}>,paragraphs:array<{_PARAGRAPH}>,{_HANGS}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, tree (JSON): one file a document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("tree"))


def nested(trees: DataFrame) -> DataFrame:
    """trees with the tree as nested columns; null where it isn't JSON of that form."""
    return trees.withColumn("tree", F.from_json("tree", TREE))


def split(trees: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Trees that break no rule, to be written, and the rules that the others break."""
    broken = validate.violations(trees, key)
    return trees.join(broken.select(key).distinct(), key, "left_anti"), broken


def documents(plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: an office document from each document's rows (key, ord, style, text)."""

    @F.pandas_udf(T.BinaryType())
    def made(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: docx.write([(p["style"], p["text"]) for p in x]))

    rows = F.array_sort(F.collect_list(F.struct("ord", "style", "text")))
    return plan.groupBy(key).agg(rows.alias("p")).select(key, made("p").alias("content"))


def comparisons(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: a comparison table as an office document from each document's changed rows (compare.rows)."""

    @F.pandas_udf(T.BinaryType())
    def made(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: docx.comparison([{"old": json.loads(r["old"]), "new": json.loads(r["new"]), "note": r["note"]} for r in x]))

    listed = F.array_sort(F.collect_list(F.struct("ord", "old", "new", "note")))
    return rows.groupBy(key).agg(listed.alias("r")).select(key, made("r").alias("content"))
