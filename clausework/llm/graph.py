"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _directed(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """Each u's neighbours joined to the smallest of them and u, written; keep_larger: only those above u.

    The minima are written before they are joined, so that both sides of the join are plain rows and a hub's rows can be split.
    """
    least = C.stored(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "star-least")
    joined = pairs.join(least.hint("merge"), "a")
    if keep_larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = C.stored(_directed(out), "star")
    C.drop_stored(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it can reach) for every node of edges (a, b); single nodes have no edge and no row.

    Rounds go on until one changes no edge, which is told by comparing all of them.
    """
    edges = C.stored(_directed(edges), "star")
    n = edges.count()
    while n:
        large = _star(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        now = _star(large, False)
        C.drop_stored(large)
        m = now.count()
        same = m == n and not now.join(edges.hint("merge"), ["a", "b"], "left_anti").limit(1).count()
        C.drop_stored(edges)
        edges, n = now, m
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
