"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def sample(docs: DataFrame, labels: DataFrame, label: str, fit_on: Column, each: dict[int, int], longest: int, first: int | None = None) -> list[tuple[str, int]]:
    """Texts and labels of up to each[v] documents with label v, picked by a hash of their id among the rows that fit_on allows.

    Documents of up to `first` characters come first (None: `longest`). Longer ones fill what is left of each[v], while the texts of label v
    have each[v] * longest characters or fewer, one of them at least where there is no shorter one: the bound of what is held.
    fit_on is an expression over labels' doc_id. Null and other labels are left out; a document with several labels counts
    as the highest; of rows that repeat an id the shortest is taken.
    """
    rows = labels.filter(F.col(label).isin(*each) & F.coalesce(fit_on, F.lit(False))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    texts = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("hash"))
    one = texts.join(rows, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("size", "hash")).alias("m")).select("doc_id", "y", "m.size", "m.hash")
    one = C.stored(one, "labelled")  # a row for each labelled document
    picked = []
    for v, n in each.items():
        held = 0
        for r in one.filter(F.col("y") == v).orderBy(F.col("size") > (first or longest), F.xxhash64("doc_id"), "doc_id").limit(n).collect():  # n rows of four numbers
            if held + r["size"] <= n * longest or not held:
                held += r["size"]
                picked.append((r["doc_id"], r["y"], r["hash"]))
    C.drop_stored(one)
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, hash long")
    # sum(each.values()) ids at most, so they can be broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash")).join(F.broadcast(ids), ["doc_id", "hash"])
    seen = sorted({(r["doc_id"], r["text"], r["y"]) for r in found.dropDuplicates(["doc_id", "hash"]).select("doc_id", "text", "y").collect()})
    return [(t, y) for _, t, y in seen]
