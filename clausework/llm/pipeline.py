"""The corpus pipeline: toxicity, near-dedup, suffix-array dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result and reads it again. All but the
last return the columns of documents. A row that a stage changes keeps its doc_id; one that mixing repeats comes as often as it is drawn.

Defined results: nulls, empty and long texts and repeated rows are as the operators define them (a null text is empty, and of
rows that repeat id and text near-dedup keeps one); an empty table gives an empty result; further columns pass through the
stages and clash with none of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_reuse, mixing, near_copies, suffix_dedup, toxicity
from .common import drop_stored, fresh, stored, table
from .queries import THRESHOLD, toxicity_model, vocabulary

#: How often mixing repeats the smallest source; the largest is kept whole, once.
REPEATS = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The model is fitted on the labelled rows of the documents table."""
    model = toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxicity_score")
    return toxicity.scored(docs, model, name).filter(F.col(name) < THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 0.8 or more."""
    return near_copies.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that earlier strings of 100 bytes cover; n_chars follows."""
    out = suffix_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the flattest temperature that repeats none more than REPEATS times while every document is kept."""
    return mixing.mix(docs, repeats=REPEATS, budget_share=None).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, digested: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_reuse.digest(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("suffix-array dedup", drop_repeated_passages), ("source mixing", mix_sources), ("bpe encoding", encode)]

#: SQL expresses neither the fitted model nor tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
