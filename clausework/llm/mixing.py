"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent. The exponent is the smallest for which the
weights' entropy is no more than the target, or no source is repeated beyond a limit; it is found by bisection, in which
a job evaluates SECTIONS points of the interval. A source's quota is its weight of the token budget. It is realised as
whole epochs and a part of one more: documents lie in blocks by a hash, the blocks are permuted by another, and those
are taken that the rest of the quota holds; of the next block, the documents in the order of their hash that still fit.

As the blocks taken whole come first in the permuted order, what is decided is one row for each source: its whole epochs,
the block that is cut, that block's turn and its last document taken. Documents are not joined by id, and only those of sources beyond the
BROADCAST_SOURCES largest are shuffled, by their source. A source's blocks, about BLOCK_DOCS documents each,
are summed up in two steps: over 4,096 ranges of the permuted order, then inside a range.

Defined results: a null source is the source ''; a null text has no tokens; a source without tokens, and each source of
a table without tokens, is kept once; rows that repeat an id are taken or left together; an empty table gives no rows;
targets that no exponent up to HIGHEST meets leave the sources' shares as they are (exponent 1); further columns are kept
as they are, and where they have the name of a new one, the new ones begin with "mix__" (more underscores if need be).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents in a block, points that a bisection's job evaluates, jobs, sources whose rows are broadcast (under 200 bytes and a name each).
BLOCK_DOCS, SECTIONS, JOBS, BROADCAST_SOURCES = 256, 16, 10, 100_000
#: The interval's first upper end, which is doubled while the target isn't met, and its last.
UPPER, HIGHEST = 8.0, 4096.0


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(sizes: DataFrame) -> DataFrame:
    """source, docs, tokens, share and its logarithm (null without tokens) of each source of sizes (source, n_tokens)."""
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    by = by.crossJoin(F.broadcast(by.agg(F.sum("tokens").alias("all_tokens"))))  # one row
    return by.withColumn("log_share", F.when(F.col("tokens") > 0, F.log(F.col("tokens").cast("double") / F.col("all_tokens"))))


def _evaluate(by: DataFrame, points: list[float]) -> list[dict]:
    """For each exponent: the entropy of the weights, the highest repetition with the budget of all tokens, and with the one that keeps each source once."""
    top = by.agg(F.max("log_share")).first()[0]
    off = F.col("log_share") - top  # of the largest source 0, so that high powers don't vanish
    aggs = [f for a in points for f in (F.sum(F.exp(off * a)), F.sum(F.exp(off * a) * off), F.max(F.exp(off * (a - 1))), F.min(F.exp(off * (a - 1))))]
    row = by.agg(*aggs).first()
    out = []
    for k, a in enumerate(points):
        z, s, most, least = row[4 * k : 4 * k + 4]
        out.append({"entropy": math.log(z) - a * s / z, "repeats": most / z / math.exp(top), "cover": most / least if least else math.inf})
    return out


def exponent(by: DataFrame, entropy: float | None = None, repeats: float | None = None, budget_share: float | None = None) -> float:
    """The smallest exponent, rounded up to six digits, with at most this entropy and this many repetitions; 1 where none up to HIGHEST has.

    entropy: as a part of its largest value. budget_share: the budget over all tokens; None: as many tokens as keep every source whole.
    """
    n = by.filter("log_share is not null").count()
    if not n or (entropy is None and repeats is None):
        return 1.0
    margin = 1e-12

    def enough(x: dict) -> bool:
        r = x["cover"] if budget_share is None else x["repeats"] * budget_share
        return (entropy is None or x["entropy"] <= entropy * math.log(n) + margin) and (repeats is None or r <= repeats + margin)

    low, high = 0.0, UPPER
    if enough(_evaluate(by, [low])[0]):
        return low
    if budget_share is None and repeats is not None and entropy is None:
        high = 1.0  # where no source is repeated
    while not enough(_evaluate(by, [high])[0]):
        low, high = high, 2 * high
        if high > HIGHEST:
            return 1.0
    for _ in range(JOBS):
        points = [low + (high - low) * k / SECTIONS for k in range(1, SECTIONS)]
        good = [enough(x) for x in _evaluate(by, points)]
        first = good.index(True) if True in good else SECTIONS - 1
        low, high = (points[first - 1] if first else low), (points[first] if first < SECTIONS - 1 else high)
    return math.ceil(high * 1e6) / 1e6


def _key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _prefix(docs: DataFrame) -> str:
    """What the columns that mix() adds begin with: "mix_", or with more underscores until none of docs does."""
    p = "mix_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    return p


def _by_source(rows: DataFrame, each: DataFrame, p: str) -> DataFrame:
    """rows with the columns of their source's row of each. The largest sources' are broadcast, so no shuffled source has more than a 100,000th of all documents."""
    key = f"{p}source"
    if each.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(each), key)
    largest = stored(each.orderBy(F.desc(f"{p}docs"), key).limit(BROADCAST_SOURCES), "mix-largest")
    others = each.join(largest.select(key), key, "left_anti")
    return rows.join(F.broadcast(largest), key).unionByName(rows.join(F.broadcast(largest.select(key)), key, "left_anti").join(others, key))


def _placed(docs: DataFrame, each: DataFrame, seed: int, p: str) -> DataFrame:
    """docs with key (a document's place in its block), block, and the columns of each (a row for each source), named with the prefix."""
    each = each.select(*(F.col(c).alias(p + c) for c in each.columns)).withColumn(f"{p}blocks", F.ceil(F.col(f"{p}docs") / BLOCK_DOCS))
    docs = _by_source(docs.withColumn(f"{p}source", F.coalesce("source", F.lit(""))), each, p)
    docs = docs.withColumn(f"{p}key", _key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumn(f"{p}block", F.conv(F.substring(f"{p}key", 1, 8), 16, 10).cast("long") % F.col(f"{p}blocks"))


def _turn(seed: int, p: str) -> Column:
    """A block's place in the permuted order of its source's blocks."""
    return _key(seed, F.col(f"{p}source"), F.col(f"{p}block").cast("string"))


def _behind(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks (mix_source, mix_block, t) with their turn and behind, the tokens up to a block's end in its source's permuted order."""
    blocks = blocks.withColumn("turn", _turn(seed, "mix_")).withColumn("part", F.substring("turn", 1, 3))
    parts = blocks.groupBy("mix_source", "part").agg(F.sum("t").alias("in_part"))
    earlier = Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows of a source at most
    parts = parts.select("mix_source", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("mix_source", "part").orderBy("turn", "mix_block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.join(parts, ["mix_source", "part"]).withColumn("behind", F.col("before") + F.sum("t").over(inside)).select("mix_source", "mix_block", "t", "turn", "behind")


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget_share: float | None = 1.0, seed: int = 0) -> DataFrame:
    """A row of docs (doc_id, text, source, ...) for each epoch in which it is drawn, with mix_tokens, mix_epoch and mix_order.

    Sorted by mix_order, rows come as permuted blocks of permuted documents, sources among each other. Small tables that later
    steps only read are written to the shared folder; they are a row for each document (three numbers), block or source.
    """
    p = _prefix(docs)
    docs = docs.withColumn(f"{p}tokens", n_tokens(F.col("text")))
    sizes = stored(docs.select("doc_id", "source", F.col(f"{p}tokens").alias("mix_tokens")), "mix-sizes")
    by = stored(shares(sizes.select(F.coalesce("source", F.lit("")).alias("source"), F.col("mix_tokens").alias("n_tokens"))).coalesce(1), "mix-shares")
    a = exponent(by, entropy, repeats, budget_share)
    if budget_share is None:
        power = F.exp(F.col("log_share") * (a - 1))
        scale = by.agg((1 / F.min(power)).alias("scale"))
    else:
        top = by.agg(F.max("log_share")).first()[0] or 0.0
        power = F.exp((F.col("log_share") - top) * (a - 1))
        scale = by.agg((budget_share / F.sum(F.exp((F.col("log_share") - top) * a)) / math.exp(top)).alias("scale"))
    quota = by.crossJoin(F.broadcast(scale))  # one row
    quota = quota.withColumn("quota", F.round(F.col("tokens") * F.round(power * F.col("scale"), 9)).cast("long"))
    full = F.coalesce(F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))), F.lit(0)).cast("int")
    full = F.when(F.col("tokens") > 0, full).otherwise(F.lit(1))
    rest = F.when(F.col("tokens") > 0, F.coalesce("quota", F.lit(0)) - full * F.col("tokens")).otherwise(F.lit(-1))
    quota = quota.select(F.col("source").alias("mix_source"), "docs", full.alias("full"), rest.alias("rest"))

    placed = _placed(sizes.withColumnRenamed("mix_tokens", "t"), by.select("source", "docs"), seed, "mix_")
    blocks = _behind(placed.groupBy("mix_source", "mix_block").agg(F.sum("t").alias("t")), seed + 1)
    # the first block that isn't taken whole; there is one, as the rest of a quota is less than the source
    cut = blocks.join(quota, "mix_source").filter("behind > rest").groupBy("mix_source", "docs", "full")
    cut = cut.agg(F.min(F.struct("turn", "mix_block", (F.col("rest") - F.col("behind") + F.col("t")).alias("left"))).alias("cut"))
    cut = stored(cut.select(F.col("mix_source").alias("source"), "docs", "full", "cut.turn", F.col("cut.mix_block").alias("cut"), "cut.left"), "mix-cut")

    inside = Window.partitionBy("mix_source", "mix_block").orderBy("mix_key").rangeBetween(Window.unboundedPreceding, 0)
    part = _placed(sizes.withColumnRenamed("mix_tokens", "t"), cut, seed, "mix_").filter("mix_block = mix_cut").withColumn("c", F.sum("t").over(inside))  # a block of each source
    part = part.filter("c <= mix_left").groupBy(F.col("mix_source").alias("source")).agg(F.max("mix_key").alias("upto"))
    plan = stored(cut.join(part, "source", "left"), "mix-plan")
    col = lambda c: F.col(p + c)

    drawn = _placed(docs, plan, seed, p)
    own = F.struct(_turn(seed + 1, p).alias("turn"), col("block").alias("block"))
    last = F.struct(col("turn").alias("turn"), col("cut").alias("block"))
    copies = col("full") + ((own < last) | ((own == last) & F.coalesce(col("key") <= col("upto"), F.lit(False)))).cast("int")
    drawn = drawn.withColumn(f"{p}epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    order = F.concat(F.substring(_key(seed + 1, col("source"), col("block").cast("string"), col("epoch").cast("string")), 1, 16), F.substring(_key(seed + 2, col("key"), col("epoch").cast("string")), 1, 16))
    return drawn.withColumn(f"{p}order", order).select(*docs.columns, f"{p}epoch", f"{p}order")


#: DuckDB's form of mix() on documents, for entropy, repeats and a budget of all tokens.
SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         md5({seed} || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), by_source AS (
  SELECT source, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens, CASE WHEN sum(n_tokens) > 0 THEN ln(CAST(sum(n_tokens) AS DOUBLE) / (SELECT sum(n_tokens) FROM sizes)) END AS l FROM sizes GROUP BY source
), n AS (SELECT count(l) AS n FROM by_source
), bisection AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST({highest} AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN low ELSE mid END, CASE WHEN good THEN mid ELSE high END FROM (
    SELECT i, low, high, mid, (SELECT ln(sum(exp(l * mid))) - mid * sum(exp(l * mid) * l) / sum(exp(l * mid)) <= {entropy} * ln((SELECT n FROM n)) + 1e-12
      AND max(exp(l * (mid - 1))) / sum(exp(l * mid)) <= {repeats} + 1e-12 FROM by_source) AS good
    FROM (SELECT i, low, high, (low + high) / 2 AS mid FROM bisection WHERE i < 43)
  )
), a AS (SELECT ceil(high * 1e6) / 1e6 AS a FROM bisection WHERE i = 43
), scale AS (SELECT a, 1.0 / sum(exp(l * a)) AS scale FROM by_source, a GROUP BY a
), quota AS (
  SELECT source, docs, tokens, CAST(round(tokens * round(exp(l * (a - 1)) * scale, 9)) AS BIGINT) AS quota FROM by_source, scale
), rest AS (
  SELECT source, CAST(ceil(docs / {block}) AS BIGINT) AS n_blocks, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS full_epochs, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM quota
), placed AS (
  SELECT s.*, CAST('0x' || substr(k, 1, 8) AS BIGINT) % n_blocks AS block FROM sizes s JOIN rest USING (source)
), blocks AS (
  SELECT source, block, sum(n_tokens) AS t FROM placed GROUP BY ALL
), summed AS (
  SELECT *, sum(t) OVER (PARTITION BY source ORDER BY md5({next_seed} || '|' || source || '|' || block), block ROWS UNBOUNDED PRECEDING) AS behind FROM blocks
), inside AS (
  SELECT p.*, full_epochs, rest - (behind - t) AS left_over, t,
         sum(n_tokens) OVER (PARTITION BY p.source, p.block ORDER BY k RANGE UNBOUNDED PRECEDING) AS c
  FROM placed p JOIN summed USING (source, block) JOIN rest USING (source)
), copies AS (SELECT doc_id, source, n_tokens, block, k, full_epochs + CASE WHEN t <= left_over OR c <= left_over THEN 1 ELSE 0 END AS copies FROM inside)
, drawn AS (SELECT *, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS epoch FROM copies WHERE copies > 0)
SELECT doc_id, source, n_tokens, epoch,
  substr(md5({next_seed} || '|' || source || '|' || block || '|' || epoch), 1, 16) || substr(md5({last_seed} || '|' || k || '|' || epoch), 1, 16) AS mix_order
FROM drawn
"""


def sql(entropy: float, repeats: float, seed: int = 0) -> str:
    return SQL.format(entropy=entropy, repeats=repeats, seed=f"'{seed}'", next_seed=f"'{seed + 1}'", last_seed=f"'{seed + 2}'", highest=UPPER, block=f"{BLOCK_DOCS}.0")
