"""Where source paragraphs and their reference fields are in a formatted document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST = 4


def match(sources: list[str], targets: list[str]) -> list[int | None]:
    """For each source text in order the place of its paragraph: an equal one, else one that holds it or that it holds; of several, the first not before the last match."""
    out: list[int | None] = []
    reached = 0
    exact: dict[str, list[int]] = {}
    for i, t in enumerate(targets):
        exact.setdefault(t, []).append(i)
    for s in sources:
        places = (exact.get(s) or [i for i, t in enumerate(targets) if min(len(s), len(t)) >= LEAST and (s in t or t in s)]) if s else []
        at = next((i for i in places if i >= reached), places[0] if places else None)
        reached = at if at is not None else reached
        out.append(at)
    return out


def find(sources: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, found: the place in targets (key, pos, text) of each of sources (key, pos, text)."""

    @F.pandas_udf("array<int>")
    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([match(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    listed = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", T.reference_norm(F.coalesce("text", F.lit(""))).alias("t")))).alias(name))
    both = listed(sources, "s").join(listed(targets, "t"), key, "left").withColumn("t", F.coalesce("t", F.array().cast("array<struct<pos:int,t:string>>")))
    both = both.withColumn("f", places(F.transform("s", lambda x: x["t"]), F.transform("t", lambda x: x["t"])))
    return both.select(key, "t", F.explode(F.arrays_zip("s", "f")).alias("z")).select(key, "z.s.pos", F.get("t", F.col("z.f"))["pos"].alias("found"))


def numbered_neighbour(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, pos, level, label) with at: the paragraph that bears the article's number, for a bookmark on this one.

    That is the paragraph itself, the heading right before it on a higher level, or the paragraph right behind it on a lower one; one without a level stays.
    """
    order = Window.partitionBy(key).orderBy("pos")
    side = lambda f, c: f(c).over(order)
    before = F.coalesce(side(F.lag, "label").contains("条") & (side(F.lag, "level") < F.col("level")), F.lit(False))
    behind = F.coalesce(side(F.lead, "label").contains("条") & (side(F.lead, "level") > F.col("level")), F.lit(False))
    own = F.col("level").isNull() | F.coalesce(F.col("label").contains("条"), F.lit(False))
    return rows.withColumn("at", F.when(own, F.col("pos")).when(before, side(F.lag, "pos")).when(behind, side(F.lead, "pos")).otherwise(F.col("pos")))
