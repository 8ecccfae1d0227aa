"""Exact top-k search by tiled matrix products.

Queries are cut into tiles, which are written to the shared folder; tiles fall into groups and rows into shards, both of a
bounded size, and each group meets each shard in one task: both sides are dealt out by (group, shard). A task keeps, for each
tile, only the k best of each query (a partial selection), and the partial lists of a tile are merged in a tree, FAN lists at
a time. The product is a floating-point matrix product where the largest possible sum is below 2**53, and one of 64-bit
integers elsewhere. Nothing goes through the driver or is broadcast.

Defined results: scores must fit 64 bits; vectors that are null, or hold a null or a component that isn't finite, take no part; vectors of
different length are never compared; rows that share the query's vec_id are its own; other repeated rows all count; ties
go to the smaller vec_id; with no candidate a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Queries in a tile, rows that a product takes together, bytes of a group of tiles and of a shard of rows, lists merged at a time.
TILE, BLOCK, GROUP_BYTES, SHARD_BYTES, FAN = 256, 4096, 16 << 20, 8 << 20, 8
TILES = "grp int, tile long, n int, ids binary, data binary"
LISTS = "tile long, part int, n int, ids binary, scores binary"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
#: The score of a place without a row.
NONE = np.iinfo(np.int64).min


def quantized(scale: float = 64.0, column: str = "embedding") -> Column:
    """floor(scale * x) of each component as a whole number; null for a vector that takes no part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~bad, F.transform(column, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length that occurs: the rows with it, their vectors as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    starts = vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
    return [(rows := np.flatnonzero(sizes == n), flat[starts[rows][:, None] + np.arange(n)]) for n in np.unique(sizes)]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores, ties to the smaller id."""
    if scores.shape[1] > 4 * k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        wide = int((scores >= cut).sum(1).max())  # with ties more than k
        at = np.argsort(scores < cut, axis=1, kind="stable")[:, :wide]
        ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = lambda m: int(np.abs(m).max()) if m.size else 0
    if top(q) * top(c) * max(1, q.shape[1]) < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _tile(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of about `most` queries of one group and length, from rows (grp, id, v) sorted by the group."""
    from pyspark import TaskContext

    made, held = TaskContext.get().partitionId() << 32, {}

    def flush(key: tuple[int, int]) -> pa.RecordBatch:
        nonlocal made
        ids, data = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        made += 1
        row = (key[0], made, len(ids), ids.tobytes(), np.ascontiguousarray(data).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["grp", "tile", "n", "ids", "data"])

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            grp, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
            for where, m in _matrix(part.column(2)):
                for g in np.unique(grp[where]).tolist():
                    mine = grp[where] == g
                    held.setdefault((g, m.shape[1]), []).append((ids[where][mine], m[mine]))
            for key in [k for k, x in held.items() if sum(len(i) for i, _ in x) >= most or k[0] != grp[-1]]:
                yield flush(key)
    for key in list(held):
        yield flush(key)


def _meet(k: int, step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (grp, shard), whose tiles come before its rows: the k best of each tile's queries."""
    now, tiles, tops = None, [], []

    def lists() -> Iterator[pa.RecordBatch]:
        for (tile, _, _), top in zip(tiles, tops, strict=True):
            if top is not None:
                yield _list(tile, now[1], *top)

    for batch in batches:
        grp, shard = (batch.column(c).to_numpy() for c in (0, 1))
        edge = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (shard[1:] != shard[:-1])))) if batch.num_rows else []
        for a, b in zip(edge, [*edge[1:], batch.num_rows], strict=True):
            if now != (int(grp[a]), int(shard[a])):
                yield from lists()
                now, tiles, tops = (int(grp[a]), int(shard[a])), [], []
            part = batch.slice(a, b - a)
            first = int(np.count_nonzero(part.column(2).to_numpy() == 0))
            for tile, n, ids, data in zip(*(part.column(c).slice(0, first).to_pylist() for c in range(3, 7)), strict=True):
                tiles.append((tile, np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(n, -1)))
                tops.append(None)
            for at in range(first, b - a, step):
                block = part.slice(at, step)
                ids = block.column(7).to_numpy(zero_copy_only=False)
                for where, m in _matrix(block.column(8)):
                    for t, (_, qid, q) in enumerate(tiles):
                        if q.shape[1] != m.shape[1]:
                            continue
                        s = _product(q, m)
                        cid = np.broadcast_to(ids[where], s.shape)
                        s[cid == qid[:, None]] = NONE
                        new = best(cid, s, k)
                        if tops[t] is not None:
                            new = best(np.hstack((tops[t][0], new[0])), np.hstack((tops[t][1], new[1])), k)
                        tops[t] = new
    yield from lists()


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The k best rows of `vectors` (key long, vector array<long>) by inner product for each row that is_query marks: query_id, rank, key, score."""
    spark = vectors.sparkSession
    C.bound_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null")
    size = F.size("v") * 8 + 16
    asked, total = rows.agg(F.sum(F.when(F.col("q"), size)), F.sum(size)).first()
    groups, shards = (max(1, -(-(x or 0) // most)) for x, most in ((asked, GROUP_BYTES), (total, SHARD_BYTES)))
    deal = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    tiles = rows.filter("q").select(deal(1, groups).alias("grp"), "id", "v").repartition(groups, "grp").sortWithinPartitions("grp", "id")
    tiles = C.stored(tiles.mapInArrow(C.trimmed(partial(_tile, TILE)), TILES), "top-k-tiles")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = lambda *kinds: [F.lit(None).cast(t) for t in kinds]
    names = ["grp", "shard", "kind", "tile", "n", "ids", "data", "id", "v"]
    left = tiles.withColumn("shard", every(shards)).select("grp", "shard", F.lit(0), "tile", "n", "ids", "data", *empty("long", "array<long>")).toDF(*names)
    right = rows.withColumn("shard", deal(2, shards)).withColumn("grp", every(groups)).select("grp", "shard", F.lit(1), *empty("long", "int", "binary", "binary"), "id", "v").toDF(*names)
    meet = left.unionByName(right).repartition(groups * shards, "grp", "shard").sortWithinPartitions("grp", "shard", "kind")
    lists = tree_merge(meet.mapInArrow(C.trimmed(partial(_meet, k, BLOCK)), LISTS), k, shards).join(tiles.select("tile", F.col("ids").alias("queries")).hint("merge"), "tile")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, scores, queries in zip(*(batch.column(c).to_pylist() for c in ("ids", "scores", "queries")), strict=True):
                q = np.frombuffer(queries, np.int64)
                i, s = (np.frombuffer(x, np.int64).reshape(len(q), -1) for x in (ids, scores))
                keep = s != NONE
                rank = np.broadcast_to(np.arange(1, i.shape[1] + 1, dtype=np.int32), i.shape)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(q, keep.sum(1)), rank[keep], i[keep], s[keep])], ["query_id", "rank", key, "score"])

    return lists.mapInArrow(C.trimmed(unpack), f"query_id long, rank int, {key} long, score long")


def _list(tile: int, part: int, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    row = (tile, part, len(ids), np.ascontiguousarray(ids).tobytes(), np.ascontiguousarray(scores).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _KINDS, strict=True)], ["tile", "part", "n", "ids", "scores"])


def tree_merge(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """One list for each tile: FAN lists of a tile become one, until one is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for tile, part, n, ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new, old = [np.frombuffer(x, np.int64).reshape(n, -1) for x in (ids, scores)], held.get((tile, part))
                held[tile, part] = new if old is None else best(np.hstack((old[0], new[0])), np.hstack((old[1], new[1])), k)
        for (tile, part), top in held.items():
            yield _list(tile, part, *top)

    while True:
        parts = -(-parts // FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition("tile", "part").mapInArrow(C.trimmed(run), LISTS)
        if parts <= 1:
            return lists
