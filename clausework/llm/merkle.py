"""A Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups' roots, and a proof for each row.

Places come from a sort by ranges of (group, key, leaf), whose partitions number their own rows; what stands before a
partition is a window over one row for each partition and group, so that no group is ever sorted or numbered in one
task. A level is a window over the runs of FAN nodes, whose full-frame list is both the parent's preimage and the siblings; one
row of each run stays as the parent. Proofs go down again, a join a level. Rows are shuffled as digests, never with their texts.

Defined results: null keys and groups are values of their own and come first; rows of a group with equal keys stand in the
order of their leaves, so rows that repeat have proofs of their own places; an empty table gives no rows; further columns pass
through whatever their names; a lone node is its own root, and its proof has no step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: Nodes in a run.
FAN = 16


def framed(c: Column) -> Column:
    """A field as text whose end is known: its UTF-8 bytes, a colon, the value; a dash for null."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(framed, fields)), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, node, lambda at, step: F.sha2(F.concat(F.array_join(step["before"], ""), at, F.array_join(step["after"], "")), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level from left to right, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda step: F.concat(step["before"], step["after"]))), "")


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _placed(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """nodes, written out, with tree (a number for each group, ascending as the groups do), place in the group from 0 on, and n, the group's rows."""
    spread = nodes.withColumn("tie", F.monotonically_increasing_id())  # rows that repeat may be many
    by = [F.col(c).asc_nulls_first() for c in (*group, *order, "tie")]
    rows = stored(spread.orderBy(*by).drop("tie").withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "merkle")
    whole = Window.partitionBy(*group)
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("task", *group).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    starts = starts.select(F.col("task").alias("in_task"), *(F.col(c).alias(f"of_{c}") for c in group), "first", F.min("first").over(whole).alias("tree"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("ahead"), F.sum("here").over(whole).alias("n"))
    same = F.col("task") == F.col("in_task")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(starts, same).select(*nodes.columns, "tree", (F.col("ahead") + F.col("at") - F.col("first")).alias("place"), "n")


def _parents(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level over (tree, place, n, hash), with the run that each parent is made of."""
    nodes = nodes.filter("n > 1").withColumn("up", F.floor(F.col("place") / fan).cast("long"))
    run = Window.partitionBy("tree", "up").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parent = nodes.withColumn("run", F.collect_list("hash").over(run)).filter(F.col("place") % fan == 0)
    above = F.unhex(F.sha2(F.array_join(F.transform("run", _text), ""), 256))
    return parent.select("tree", F.col("up").alias("place"), F.ceil(F.col("n") / fan).cast("long").alias("n"), above.alias("hash"), "run")


def _levels(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """All levels above nodes, written out, for trees of at most `most` leaves."""
    out = []
    while most > 1:
        nodes = stored(_parents(nodes, fan), "merkle")
        out.append(nodes)
        most = -(-most // fan)
    return out


def _roots(nodes: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """The roots (tree, hash) that stand on each level, from the leaves on."""
    return [x.filter("n = 1").select("tree", "hash") for x in (nodes, *levels)]


def _proved(nodes: DataFrame, levels: list[DataFrame], tops: list[DataFrame], fan: int) -> DataFrame:
    """nodes with the proof of each, and the further columns of tops: the roots of each level as (tree, proof, ...)."""
    more = [c for c in tops[0].columns if c not in ("tree", "proof")]
    up = None
    for k in range(len(levels), -1, -1):
        ended = tops[k].select("tree", F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<binary>").alias("siblings"), "proof", *more)
        above = ended if up is None else ended.unionByName(up.select("tree", F.col("place").alias("up"), F.col("run").alias("siblings"), "proof", *more))
        here = (levels[k - 1] if k else nodes).withColumn("up", F.floor(F.col("place") / fan).cast("long"))
        within = (F.col("place") % fan).cast("int")
        hexed = F.transform("siblings", _text)
        step = F.struct(F.slice(hexed, F.lit(1), within).alias("before"), F.slice(hexed, within + 2, F.lit(fan)).alias("after"))
        joined = here.join(above, ["tree", "up"])
        up = joined.select(*(c for c in here.columns if c != "up"), *more, F.when(F.col("siblings").isNull(), F.col("proof")).otherwise(F.concat(F.array(step), F.col("proof"))).alias("proof"))
    return up


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def manifest(rows: DataFrame, leaf_column: str = "leaf", key: str = "doc_id", group: str = "source", fan: int = FAN) -> DataFrame:
    """rows with subroot and root (lowercase hex) and proof array<struct<before array<string>, after array<string>>>, a step a level from the leaf to the root.

    leaf_column holds lowercase hex of 256 bits. Groups stand in the order of their names, null first, by UTF-8 bytes.
    """
    names = dict(zip(("subroot", "root", "proof"), (fresh(rows, x) for x in ("subroot", "root", "proof")), strict=True))
    kept = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.unhex(F.col(leaf_column)).alias("hash"), F.struct(*(F.col(c) for c in rows.columns if c not in (group, key, leaf_column))).alias("more") if set(rows.columns) - {group, key, leaf_column} else F.lit(None).cast("int").alias("more"))
    nodes = _placed(stored(kept, "merkle"), ["g"], ["k", "hash"])
    levels = _levels(nodes, _largest(nodes), fan)
    ends = _roots(nodes, levels)
    subroots = ends[0]
    for x in ends[1:]:
        subroots = subroots.unionByName(x)
    subroots = _placed(stored(subroots.select(F.lit(0).alias("all"), F.col("tree").alias("of"), "hash"), "merkle"), ["all"], ["of"])
    upper = _levels(subroots, _largest(subroots), fan)
    none = F.array().cast("array<struct<before:array<string>,after:array<string>>>")
    root = [x.select("tree", none.alias("proof"), F.col("hash").alias("root")) for x in _roots(subroots, upper)]
    tops = stored(_proved(subroots, upper, root, fan).select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", "proof"), "merkle")
    out = _proved(nodes, levels, [tops.join(x.select("tree"), "tree") for x in ends], fan)
    back = {group: F.col("g"), key: F.col("k"), leaf_column: _text(F.col("hash"))}
    return out.select(*((back[c] if c in back else F.col("more").getField(c)).alias(c) for c in rows.columns), _text(F.col("subroot")).alias(names["subroot"]), _text(F.col("root")).alias(names["root"]), F.col("proof").alias(names["proof"]))
