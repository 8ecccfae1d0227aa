"""Near copies among documents by SimHash: five-word shingle sets that two documents share to a given part.

Each text has a SimHash of BITS bits, by the majority of its shingles' hashes, and BANDS keys, each made of ROWS smallest
shingle hashes under permutations of its own. Texts that share a key meet in a cell; two of similarity s do so in some cell
with probability 1 - (1 - s**ROWS)**BANDS (1 - 4e-7 at 0.8). Fingerprints of such texts differ in at most RADIUS bits, and
so do their distances to any reference fingerprint, but for chance below 1e-8.

* First, each text is compared with its cells' smallest one, each pair once. Cells whose texts are connected then are done,
  which large groups of copies are, however many texts they hold.
* In a cell that isn't, PIVOTS of its own fingerprints, each as far as can be from those before it, are references. All
  texts' distances to them are computed once; pairs of unconnected texts are discarded by their largest difference in any of
  these, then by their own distance. A cell of over BLOCK texts is dealt out as pairs of blocks, so no task has a large one.

Survivors are decided by their whole shingle sets, which are kept in files of the shared folder, for texts that share a cell
only. Equal texts are one entry, so exact copies are one row before anything is dealt out. Only links of a forest are sent on.

Defined results: a null text is empty; texts without words are equal to each other; texts shorter than a shingle are one
shingle; repeated rows are copies; a null id never stands for a group that has another; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

BANDS, ROWS, BITS, RADIUS, PIVOTS, BLOCK = 28, 4, 256, 84, 16, 512
#: Bytes of shingle hashes in a file, and of those that a task keeps at hand.
FILE_BYTES, CACHE_BYTES = 8 << 20, 16 << 20
#: Shingles whose bits are counted together, and in one byte.
VOTES, LANE = 8_192, 255
PLANES = [f"fp{k}" for k in range(BITS // 64)]
_SALTS = np.random.default_rng(31).integers(1, 2**63, len(PLANES), dtype=np.uint64)
_FLIPS = np.random.default_rng(23).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_FACTORS = np.random.default_rng(29).integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FEATURES = f"doc_id long, hash long, node long, {', '.join(f'{p} long' for p in PLANES)}, keys array<long>"
_SETS = ["u8", "i8", "u1", "i8"]  # hash of the text, id, whether the id is null, node
_KEPT = ["u8", "i8", "u1", "u1"]  # hash of the text, id, whether the id is null, whether the row is repeated


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each distinct shingle, ascending inside a document, and the document it is of; every document has one at least."""
    h, doc = C.tokens(data, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    out, length = h.copy(), np.minimum(size, np.append(first[1:], len(h))[doc] - np.arange(len(h))) if len(h) else np.empty(0, np.int64)
    for k in range(1, size):
        more = np.flatnonzero(length > k)
        out[more] = C.mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[more + k])
    whole = (np.arange(len(h)) - first[doc] <= np.maximum(count[doc] - size, 0)) if len(h) else np.empty(0, bool)
    none = np.flatnonzero(count == 0)
    hashes, owner = np.concatenate((out[whole], np.zeros(len(none), np.uint64))), np.concatenate((doc[whole], none))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _parts(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs i to j of whole documents of a batch: their shingles, the document of each, each document's first and their number."""
    data, offsets = C.text_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + C.BLOCK_BYTES // 2, "right")) - 1)
        h, owner = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
        first = np.searchsorted(owner, np.arange(j - i))
        yield i, j, h, owner, first, np.diff(np.append(first, len(h)))
        i = j


def fingerprints(h: np.ndarray, owner: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """BITS bits of each document, as 64-bit words: those that over half of its shingles' hashes set."""
    ones = np.zeros((len(first), BITS), np.int64)
    place = np.arange(len(h)) - first[owner]
    for k in range(0, len(h), VOTES):
        part, whose = h[k : k + VOTES], owner[k : k + VOTES]
        words = np.stack([C.mix(part ^ s) for s in _SALTS], 1)
        bits = np.unpackbits(words.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").view(np.uint64)  # eight counters to a word
        begin = np.flatnonzero(place[k : k + VOTES] % LANE == 0)
        begin = begin if len(begin) and begin[0] == 0 else np.concatenate(([0], begin))
        sums = np.add.reduceat(bits, begin, axis=0).view(np.uint8)
        np.add.at(ones, whose[begin], sums)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64)


def band_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS keys of each document."""
    narrow = (h >> np.uint64(32)).astype(np.uint32)
    least = [np.minimum.reduceat((narrow ^ s) * m, first).astype(np.uint64) for s, m in zip(_FLIPS, _FACTORS, strict=True)]
    out = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(first), b, np.uint64)
        for x in least[ROWS * b : ROWS * (b + 1)]:
            key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
        out[:, b] = key
    return out


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, hash (XXH64 of the text), node (of equal texts the same), fingerprint words and band keys of each row."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).to_numpy()
            for i, j, h, owner, first, count in _parts(batch.column(1), size):
                fp, keys = fingerprints(h, owner, first, count), band_keys(h, first)
                node = C.mix(text[i:j].view(np.uint64) ^ C.mix(keys[:, 0] + fp[:, 0])).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(node), *(pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(len(PLANES))), lists], ["doc_id", "hash", "node", *PLANES, "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(C.trimmed(run), _FEATURES)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, ascending, have at least this Jaccard similarity."""
    a, b = sorted((a, b), key=len)
    if len(a) < least * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= least * (len(a) + len(b) - common)


def distances(fp: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Bits in which the fingerprints (rows) differ from one."""
    return np.bitwise_count(fp ^ to).sum(1).astype(np.int16)


def pivot_table(fp: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Distances of each fingerprint to n of them, each the farthest from those before it; fewer if all others are equal to one."""
    columns = [distances(fp, fp[0])]
    nearest = columns[0].copy()
    while len(columns) < n and (far := int(nearest.argmax())) >= 0 and nearest[far] > 0:
        columns.append(distances(fp, fp[far]))
        np.minimum(nearest, columns[-1], out=nearest)
    return np.stack(columns, 1)


def cell_links(node: list[int], root: np.ndarray, part: np.ndarray, fp: np.ndarray, whole: Callable[[int], np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what is similar in a cell, of entries of different roots, and of different parts unless all are of one."""
    table, out = pivot_table(fp), []
    _, root = np.unique(root, return_inverse=True)
    across = part.min() != part.max()
    for i in range(1, len(node)):
        near = np.flatnonzero((root[:i] != root[i]) & ((part[:i] != part[i]) | (not across)))
        near = near[np.abs(table[near] - table[i]).max(1, initial=0) <= RADIUS]
        bits = distances(fp[near], fp[i])
        near = near[bits <= RADIUS][np.argsort(bits[bits <= RADIUS], kind="stable")]
        while len(near):
            j = int(near[0])
            if similar(whole(i), whole(j), least):
                out.append((node[i], node[j]))
                root[root == root[j]] = root[i]
            near = near[1:]
            near = near[root[near] != root[i]]
    return out


class _Sets:
    """Reads shingle sets from their files; keeps what was read last."""

    def __init__(self):
        self.held, self.size = {}, 0

    def __call__(self, file: str, start: int, count: int) -> np.ndarray:
        if (file, start) not in self.held:
            if self.size > CACHE_BYTES:
                self.held.clear()
                self.size = 0
            self.held[file, start] = x = C.file_part(file, "u8", start, count)
            self.size += x.nbytes
        return self.held[file, start]


def _groupwise(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """The further columns of rows that agree in the first width columns, and stand together."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if len(held) > 1:
                    yield held
                held, now = [], row[:width]
            held.append(row[width:])
    if len(held) > 1:
        yield held


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _row_key(df_id: str | Column, text_hash: Column) -> list[Column]:
    """What tells a row of documents: its text's hash (mixed), its id, and whether that is null."""
    of = F.col(df_id) if isinstance(df_id, str) else df_id
    return [F.xxhash64(text_hash).alias("at"), F.coalesce(of.cast("long"), F.lit(0)).alias("of"), of.isNull().cast("int").alias("none")]


def _whole_sets(docs: DataFrame, wanted: DataFrame, size: int, folder: str) -> DataFrame:
    """Writes all shingle hashes of the wanted nodes (node, first), many to a file: node, file, start and count of each. Texts aren't shuffled."""
    spark = docs.sparkSession
    shelf = C.shelve(wanted.select(*_row_key(F.col("first.doc_id"), F.col("first.hash")), "node"), wanted.count(), _SETS, "near-copies-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            raw = b"".join(h.tobytes() for _, h in held)
            name = f"{folder}/{hashlib.blake2b(raw, digest_size=16).hexdigest()}"
            C.put_file(name, raw)
            count = np.array([len(h) for _, h in held])
            out = [pa.array([n for n, _ in held], pa.int64()), pa.array([name] * len(held)), pa.array(np.cumsum(count) - count), pa.array(count)]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["node", "file", "start", "count"])

        total = 0
        for batch in batches:
            who, (of, none, node) = shelf.of(batch.column(1).to_numpy().view(np.uint64))
            same = (batch.column(2).to_numpy()[who] == of) & (batch.column(3).to_numpy()[who] == none)
            who, node = who[same], node[same]
            if not len(who):
                continue
            for i, j, h, _, first, count in _parts(batch.column(0).take(pa.array(who)), size):
                held += [(int(node[i + k]), h[a : a + n].copy()) for k, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True))]
                total += h.nbytes
                if total >= FILE_BYTES:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    rows = docs.select("text", *_row_key("doc_id", F.xxhash64("text")))
    out = C.stored(rows.mapInArrow(C.trimmed(run), "node long, file string, start long, count long").dropDuplicates(["node"]), "near-copies-sets")
    C.discard(spark, shelf.folder)
    return out


def groups(docs: DataFrame, size: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A row (node, first: its smallest row's none, doc_id and hash) for each distinct text, and classes (node, root) of the nodes that are linked."""
    spark = docs.sparkSession
    seen = C.stored(features(docs, size), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    texts = C.stored(seen.groupBy("node").agg(first, *(F.first(c).alias(c) for c in (*PLANES, "keys"))), "near-copies-texts")
    C.drop_stored(seen)
    cells = texts.select("node", F.explode("keys").alias("key"))
    heads = C.stored(cells.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1"), "near-copies-heads")
    members = C.stored(cells.join(heads.hint("merge"), "key"), "near-copies-members")
    wanted = C.stored(texts.join(members.select("node").distinct().hint("merge"), "node").select("node", "first", *PLANES), "near-copies-wanted")
    folder = C.shared_dir(spark, "near-copies-shingles")
    sets = _whole_sets(docs, wanted, size, folder)
    entries = C.stored(wanted.select("node", *PLANES).join(sets.hint("merge"), "node"), "near-copies-entries")
    C.drop_stored(heads, wanted, sets)
    width = len(PLANES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Sets()
        for batch in batches:
            a, b = (np.stack([batch.column(k + j).to_numpy() for j in range(width)], 1).view(np.uint64) for k in (1, width + 5))  # signed, np.bitwise_count would count another number's bits
            near = np.flatnonzero(np.bitwise_count(a ^ b).sum(1) <= RADIUS)
            rows = batch.take(pa.array(near))
            (node, *x), (other, *y) = ([rows.column(k).to_pylist() for k in (at, at + width + 1, at + width + 2, at + width + 3)] for at in (0, width + 4))
            mine, theirs = list(zip(*x, strict=True)), list(zip(*y, strict=True))
            yield _links([(node[i], other[i]) for i in sorted(range(len(near)), key=theirs.__getitem__) if similar(read(*mine[i]), read(*theirs[i]), least)])

    pairs = members.filter("node <> head").select("node", "head").distinct()
    heads = entries.select(*(F.col(c).alias(f"head_{c}" if c != "node" else "head") for c in entries.columns))
    both = pairs.join(entries.hint("merge"), "node").join(heads.hint("merge"), "head").select(*entries.columns, *heads.columns)
    links = C.stored(both.mapInArrow(C.trimmed(compare), "a long, b long"), "near-copies-links")

    # what is open: cells with texts, other than the head, that aren't connected by now
    linked = components(links)
    rest = C.stored(members.filter("node <> head").select("key", "n", "node").join(linked.hint("merge"), "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root")), "near-copies-rest")
    C.drop_stored(members)
    open_ = C.stored(rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"), "near-copies-open")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rest.join(open_.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "root", "part", "node")
    dealt = dealt.join(entries.hint("merge"), "node").select("key", "i", "j", "root", "part", *entries.columns)

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Sets()
        for held in _groupwise(batches, 3):
            root, part, node, *rest = zip(*held, strict=True)
            fp = np.ascontiguousarray(np.array(rest[:width], np.int64).T).view(np.uint64)
            place = list(zip(*rest[width:], strict=True))
            yield _links(cell_links(node, np.array(root, np.int64), np.array(part), fp, lambda i, place=place: read(*place[i]), least))

    more = C.stored(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(C.trimmed(connect), "a long, b long"), "near-copies-links")
    C.discard(spark, folder)
    C.drop_stored(rest, open_, entries)
    out = components(links.unionByName(more))
    C.drop_stored(links, more)
    return texts, out


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (a null is larger than any); of rows that repeat id and text, one. Columns as in docs."""
    texts, linked = groups(docs, size, least)
    rooted = texts.select("node", "first").join(linked.hint("merge"), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash")).groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    same = stay["doc_id"].eqNullSafe(rows["doc_id"]) & (stay["hash"] == rows["hash"])
    stay = C.stored(stay.join(rows.hint("merge"), same).select(*_row_key(stay["doc_id"], stay["hash"]), (F.col("n") > 1).cast("int").alias("more")), "near-copies-stay")
    C.drop_stored(texts)
    n, repeated = stay.agg(F.count("*"), F.sum("more")).first()
    shelf = C.shelve(stay, n, _KEPT, "near-copies-kept")
    C.drop_stored(stay)

    @F.pandas_udf("int")
    def place(at, of, none):  # 0: the row goes, 1: it stays, 2: it is repeated
        import pandas as pd

        who, (doc, null, more) = shelf.of(at.to_numpy().view(np.uint64))
        out = np.zeros(len(at), np.int32)
        same = (of.to_numpy()[who] == doc) & (none.to_numpy()[who] == null)
        out[who[same]] = 1 + more[same]
        return pd.Series(out)

    name = C.fresh(docs, "near_copy_place")
    marked = docs.withColumn(name, place(*_row_key("doc_id", F.xxhash64("text"))))
    kept = marked.filter(F.col(name) == 1) if repeated else marked.filter(F.col(name) > 0)
    if repeated:
        text = C.fresh(docs, "near_copy_text")
        kept = kept.unionByName(marked.filter(F.col(name) == 2).withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text))
    return kept.select(*docs.columns)
