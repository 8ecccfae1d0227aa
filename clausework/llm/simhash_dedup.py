"""SimHash near-dedup with pivot distance tables.

Equal fingerprints are one entry. Entries that agree in two of four 16-bit blocks meet in a cell (two fingerprints with
at most two differing bits do so in some cell). There the distances of each entry to PIVOTS reference fingerprints are
computed once; entries are sorted by the first distance, pairs whose distances to any pivot differ by more than the
radius are discarded, and the survivors' own distance is counted. A task sends on a spanning forest of its links, never
all pairs. A cell with more than CELL entries is split exactly: two of its entries are linked if and only if they agree
once some two of the 32 remaining bits are masked, so each pair of bits is a key, with at most four entries to a key.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other; repeated
rows each have their row; null ids never name a component unless it has no other; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import votes
from .graph import components

RADIUS, PIVOTS, CELL, BLOCKS = 2, 16, 8_192, 4
#: Entries that a task looks at together, whole cells but for the last.
TOGETHER = 1 << 16
_REFERENCES = np.random.default_rng(11).integers(0, 2**63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.arange(PIVOTS, dtype=np.uint64) % np.uint64(2)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row, fingerprint (16 hexadecimal digits) by the majority of XXH64 (seed 42) of the word shingles."""
    df = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), votes.words(F.col("text")).alias("words"))
    few = F.when((F.size("words") > 0) & (F.col("segment") == 0) & (F.size("words") < shingle), F.array(F.xxhash64(F.array_join("words", " "))))
    df = votes.segments(df, "words", shingle - 1)
    gram = F.transform("words", lambda w, i: F.xxhash64(F.concat_ws(" ", w, *(F.get("words", i + k) for k in range(1, shingle)))))
    terms = F.when(F.size("words") >= shingle, F.slice(gram, F.lit(1), F.least(F.size("words") - shingle + 1, F.lit(votes.SEGMENT)))).otherwise(few)
    return votes.tally(df, ["doc_id", "row"], terms, [lambda t: t])


def _cells(prints: DataFrame) -> DataFrame:
    part = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.struct(F.lit(t).alias("tab"), F.shiftleft(part(i), 16).bitwiseOR(part(j)).alias("key")) for t, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.tab", "k.key", "fp")


def pivot_links(cell: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of linked pairs of the same cell."""
    table = np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], cell))
    cell, table, sorted_fp = cell[order], table[order], fp[order]
    left = np.arange(len(fp))
    for k in range(1, len(fp)):
        left = left[left + k < len(fp)]
        left = left[(cell[left] == cell[left + k]) & (table[left + k, 0] - table[left, 0] <= radius)]
        if not len(left):
            return
        near = left[np.abs(table[left] - table[left + k]).max(1) <= radius]
        near = near[np.bitwise_count(sorted_fp[near] ^ sorted_fp[near + k]) <= radius]
        if len(near):
            yield order[near], order[near + k]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole cells, which stand together, some at a time."""
    held: list[list[np.ndarray]] = []

    def flush(last: bool) -> pa.RecordBatch:
        tab, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cell = tab.astype(np.int64) << 32 | key
        done = len(cell) if last else int(np.argmax(cell == cell[-1]))  # the last cell may go on
        held[:] = [[tab[done:], key[done:], fp[done:]]]
        return _spanning(cell[:done], fp[:done])

    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(3)])
        if sum(len(x) for x, *_ in held) >= TOGETHER:
            yield flush(False)
    if held:
        yield flush(True)


def _spanning(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the links of some cells."""
    _, cell, size = np.unique(cell, return_inverse=True, return_counts=True)
    keep = size[cell] > 1
    cell, fp = cell[keep], fp[keep].view(np.uint64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out: list[tuple[int, int]] = []
    signed = fp.view(np.int64)
    for a, b in pivot_links(cell, fp):
        for x, y in zip(signed[a].tolist(), signed[b].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of the distinct fingerprints prints.fp (long) that connect whatever is connected at RADIUS."""
    C.bound_batches(prints.sparkSession)
    cells = _cells(prints)
    hot = C.stored(cells.groupBy("tab", "key").count().filter(F.col("count") > CELL).select("tab", "key"), "hot-cells")
    forest = lambda df: df.repartition("tab", "key").sortWithinPartitions("tab", "key").mapInArrow(C.trimmed(_forest), "a long, b long")
    many = hot.count()
    if not many:
        return forest(cells)
    hot = F.broadcast(hot) if many <= 100_000 else hot
    out = forest(cells.join(hot, ["tab", "key"], "left_anti"))
    free = [[b for k in range(BLOCKS) if k not in chosen for b in range(16 * k, 16 * k + 16)] for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [F.array(*(F.lit(signed(1 << i | 1 << j)) for i, j in combinations(bits, 2))) for bits in free]
    wide = cells.join(hot, ["tab", "key"]).select("tab", "fp", F.explode(F.element_at(F.array(*masks), F.col("tab") + 1)).alias("mask"))
    groups = wide.groupBy("tab", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest")).agg(F.collect_set("fp").alias("some"))  # four at most
    star = groups.filter(F.size("some") > 1).select(F.explode("some").alias("a"), F.array_min("some").alias("b")).filter("a <> b")
    return out.unionByName(star.distinct())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row, fingerprint, component_id (the smallest doc_id that links reach)."""
    prints = C.stored(fingerprints(docs).withColumn("fp", votes.as_long(F.col("fingerprint"))), "simhash")
    distinct = C.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(distinct))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "row", "fingerprint", "component_id")
