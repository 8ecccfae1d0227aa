"""Suffix-array dedup: remove bytes that a string of WIDTH bytes covers which also starts earlier in the corpus.

Only places that can match are sorted. Each string of WIDTH bytes has an anchor, the place of its smallest hash of GRAM
bytes; so equal strings have equal anchors at equal places, and the starts of a document fall into runs with one anchor.
A run's stretch (the bytes of its strings) has a hash. One job deals anchors and stretches out by the anchor's hash:

* of equal stretches around equal anchors, all but the earliest are removed whole; a mapper does the same to its own
  first, so that a passage of which there are many copies is one record of a mapper;
* where stretches around equal anchors differ, the earliest of each kind is read again from its document, and its
  strings are compared by sorting.

The sort is deep-shallow: multikey quicksort on words of eight bytes down to a shallow depth, then blind tries order the
groups that still agree. The bytes from the anchor on, and those before it read backwards, are sorted so; in sorted order
the longest common prefixes of neighbours say which strings are equal, for each distance between string and anchor: one
comparison of neighbours' prefixes for both sides, instead of a sort of all strings. Anchors with more than HOT kinds of
stretches are dealt out again by the bytes that equal strings share, for PARTS ranges of that distance.

No text is shuffled except such stretches. What one job finds for a document is kept in sorted arrays in the shared
folder, which the next scan memory-maps.

Defined results: a null text is empty; texts shorter than WIDTH bytes are whole; a null id comes after all others; rows
that repeat an id are ordered by a hash of their text, and rows that repeat both are one document that comes several
times (none removes bytes of the other); an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .lm import _pack, _unpack

WIDTH, GRAM = 100, 32
STARTS = WIDTH - GRAM + 1
#: Bytes that numpy looks at together, bytes of text to a bucket, kinds of stretches of one anchor, ranges of a hot one.
SLICE, BUCKET_BYTES, HOT, PARTS = 1 << 19, 32 << 20, 4_096, 8
#: Anchors that a mapper puts together before it sends them.
HELD = 1 << 19
#: Bytes that are put together at a time.
TAKEN = 1 << 18
ROWS = "kind string, bucket int, payload binary"
_ORDER = ["u8", "u8", "i8", "u4", "u4", "u1", "u1"]  # anchor, stretch, document, tie, first start, starts, anchor's distance from the first start
_SPAN = ["u8", "u4", "u4"]  # document key, start, end
_ASK = ["u8", "u4", "u1", "u1", "u1", "u8"]  # document key, first start, starts, distance, hot, anchor


def _key(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return C.mix(C.mix(doc.astype(np.int64).view(np.uint64)) + tie.astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For some bytes at a time: document index, anchor hash, stretch hash, first start, starts, distance; starts count from data[0]."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        step = SLICE - WIDTH
        for x in range(a, max(b - WIDTH + 1, a + 1), step) if j == i + 1 and b - a > SLICE else [a]:
            end = min(b, x + SLICE - 1) if j == i + 1 else b
            found = _anchors(data[x:end], (offsets[i : j + 1] - x).clip(0, end - x))
            if found is not None:
                doc, anchor, stretch, first, count, distance = found
                yield doc + i, anchor, stretch, first + x, count, distance
        i = j


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
    n = len(data)
    if n < WIDTH:
        return None
    prefix = C.prefix_hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = C.span_hashes(prefix, at, at + GRAM)
    ranked = grams & ~np.uint64((1 << 20) - 1) | at.astype(np.uint64)
    m = -(-len(ranked) // STARTS) * STARTS
    grid = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(ranked)] = ranked
    grid = grid.reshape(-1, STARTS)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - WIDTH + 1
    least = np.minimum(back[:starts], ahead[STARTS - 1 : STARTS - 1 + starts])
    anchor = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    whole = np.zeros(starts + 1, np.int64)  # starts whose string stays inside its document
    lo, hi = offsets[:-1], np.maximum(offsets[1:] - WIDTH + 1, offsets[:-1])
    np.add.at(whole, np.minimum(lo, starts), 1)
    np.add.at(whole, np.minimum(hi, starts), -1)
    good = np.cumsum(whole[:-1]) > 0
    s = np.flatnonzero(good)
    if not len(s):
        return None
    new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1] + 1) | (anchor[s[1:]] != anchor[s[:-1]]))))
    first, where = s[new], anchor[s[new]]
    count = np.diff(np.append(new, len(s)))
    distance = where - first
    stretch = C.mix(C.span_hashes(prefix, first, first + count + WIDTH - 1) + distance.astype(np.uint64))
    # anchors have small hashes; mixed once more, they spread over all buckets
    return np.searchsorted(offsets, first, "right") - 1, C.mix(grams[where]), stretch, first, count, distance


def _later(anchor: np.ndarray, stretch: np.ndarray, doc: np.ndarray, tie: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order; in it, whether a record begins a new (anchor, stretch), and whether that stands earlier than the record."""
    order = np.lexsort((first, tie, doc, stretch, anchor))
    a, s, d, t, f = (x[order] for x in (anchor, stretch, doc, tie, first))
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return order, new, (d != d[head]) | (t != t[head]) | (f != f[head])


def _rows(kind: str, bucket: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([b], pa.int32()), pa.array([_pack([c[at] for c in columns])], pa.binary())], ["kind", "bucket", "payload"])


def _spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    key = _key(doc, tie)
    yield from _rows("span", C.bucket_of(key, bits), [key, start.astype("u4"), end.astype("u4")], 2**bits)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc and tie of each row, bytes and offsets of the texts."""
    return batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32), *C.text_bytes(batch.column(2))


def _find(bits: int) -> Callable:
    """A mapper's anchors, of equal stretches the earliest only, and spans of its later ones; HELD records at a time, so that a common passage is a record for each of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            order, new, later = _later(*columns[:5])
            gone = order[later]
            doc, tie, start, count = (columns[k][gone] for k in (2, 3, 4, 5))
            yield from _spans(doc, tie, start, start + count.astype("u4") + np.uint32(WIDTH - 1), bits)
            kept = np.sort(order[new])
            yield from _rows("anchor", C.bucket_of(columns[0][kept], bits), [c[kept] for c in columns], 2**bits)

        size = 0
        for batch in batches:
            doc, tie, data, offsets = _columns(batch)
            for i, anchor, stretch, first, count, distance in anchors(data, offsets):
                held.append([anchor, stretch, doc[i], tie[i], (first - offsets[i]).astype("u4"), count.astype("u1"), distance.astype("u1")])
                size += len(i)
            if size >= HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    groups: dict[tuple[str, int], list[bytes]] = {}
    for batch in batches:
        for kind, bucket, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups.setdefault((kind, bucket), []).append(payload)
    for key in sorted(groups):
        yield *key, groups.pop(key)


def _judge(bits: int) -> Callable:
    """Of each bucket of anchors: spans of later copies; the earliest of each kind, where an anchor has several kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _gathered(batches):
            columns = [np.concatenate(x) for x in zip(*(_unpack(r, _ORDER) for r in rows), strict=True)]
            seen = np.sort(columns[0])
            often = np.unique(seen[1:][seen[1:] == seen[:-1]])
            at = np.searchsorted(often, columns[0])
            keep = often[np.minimum(at, len(often) - 1)] == columns[0] if len(often) else np.zeros(len(at), bool)
            columns = [c[keep] for c in columns]
            if not keep.any():
                continue
            order, new, later = _later(*columns[:5])
            anchor, _, doc, tie, first, count, distance = (c[order] for c in columns)
            yield from _spans(doc[later], tie[later], first[later], first[later] + count[later] + np.uint32(WIDTH - 1), bits)
            head = np.flatnonzero(new)
            _, group, size = np.unique(anchor[head], return_inverse=True, return_counts=True)
            several = size[group] > 1
            head, kinds = head[several], size[group][several]
            key = _key(doc[head], tie[head])
            yield from _rows("ask", C.bucket_of(key, bits), [key, first[head], count[head], distance[head], (kinds > HOT).astype("u1"), anchor[head]], 2**bits)

    return run


def _keep(folder: str, kinds: list[str]) -> Callable:
    """Writes a bucket's records as arrays sorted by document key; yields the bucket's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, bucket, rows in _gathered(batches):
            C.put_bucket(folder, kind, bucket, [np.concatenate(x) for x in zip(*(_unpack(r, kinds) for r in rows), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    return run


def _shelf(rows: DataFrame, folder: str, kind: str, kinds: list[str], bits: int) -> C.Shelf:
    written = rows.repartitionById(2**bits, "bucket").mapInArrow(C.trimmed(_keep(folder, kinds)), "bucket int")
    return C.Shelf(folder, kind, kinds, bits, C.present(written, 2**bits))


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray, backwards: bool = False) -> np.ndarray:
    """data[start:start+size] of all, one behind the other, each read backwards if so asked; some at a time, as each byte needs an index."""
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    i, done = 0, 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, done + TAKEN, "right")))
        n = size[i:j].astype(np.int64)
        begin = ends[i:j] - n - done
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        at = np.repeat(start[i:j] + n - 1, n) - inside if backwards else np.repeat(start[i:j], n) + inside
        out[done : int(ends[j - 1])] = data[at]
        i, done = j, int(ends[j - 1])
    return out


_STRETCH = ["i8", "u4", "u4", "u1", "u1", "u1", "u1"]  # document, tie, first start, starts, distance, lowest and highest distance to judge


def _read(kept: C.Shelf, bits: int) -> Callable:
    """The stretches asked for, dealt out by anchor; those of a hot anchor by ranges of the distance and the bytes shared there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, data, offsets = _columns(batch)
            who, (first, count, distance, hot, anchor) = kept.of(_key(doc, tie))
            if not len(who):
                continue
            start, high = offsets[who] + first, distance.astype(np.int64)
            low = high - count + 1
            key, pick = [C.mix(anchor)], [np.flatnonzero(hot == 0)]
            limits = [(low, high)]
            if hot.any():
                for p in range(PARTS):
                    a, b = p * STARTS // PARTS, (p + 1) * STARTS // PARTS - 1
                    some = np.flatnonzero((hot == 1) & (low <= b) & (high >= a))
                    here, lo, hi = start[some] + distance[some], np.maximum(low[some], a), np.minimum(high[some], b)
                    # equal strings share the `a` bytes before the anchor and WIDTH - b from it on; every stretch judged here has them
                    shared = np.array([hash_bytes(data[x - a : x + WIDTH - b], p) for x in here.tolist()], np.uint64)
                    full = np.zeros(len(hot), np.uint64)
                    full[some] = shared
                    lows, highs = low.copy(), high.copy()
                    lows[some], highs[some] = lo, hi
                    key.append(full)
                    pick.append(some)
                    limits.append((lows, highs))
            for h, some, (lo, hi) in zip(key, pick, limits, strict=True):
                if not len(some):
                    continue
                bucket = C.bucket_of(h[some], bits)
                order = some[np.argsort(bucket, kind="stable")]
                bucket = C.bucket_of(h[order], bits)
                cuts = np.searchsorted(bucket, np.arange(2**bits + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[b] : cuts[b + 1]]
                    head = _pack([doc[who[at]], tie[who[at]], first[at], count[at], distance[at], lo[at].astype("u1"), hi[at].astype("u1")])
                    body = pa.Codec("zstd", 1).compress(_take(data, start[at], count[at].astype(np.int64) + WIDTH - 1).tobytes(), asbytes=True)
                    size = int((count[at].astype(np.int64) + WIDTH - 1).sum())
                    payload = len(head).to_bytes(8, "little") + size.to_bytes(8, "little") + head + body
                    yield pa.RecordBatch.from_arrays([pa.array(["stretch"]), pa.array([b], pa.int32()), pa.array([payload], pa.binary())], ["kind", "bucket", "payload"])

    return run


def hash_bytes(data: np.ndarray, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8, salt=bytes([salt])).digest(), "little")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings by a trie that holds only depths and branching bytes, and each one's common prefix with the one before it (0 for the first)."""
    root: list | int = 0
    byte = lambda s, d: s[d] if d < len(s) else -1
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while type(node) is list:  # blindly: bytes between the depths aren't looked at
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
            node = node[0] if type(node) is tuple else node
        depth = common_prefix(s, strings[node])
        other, parent, node, via = strings[node], None, root, None
        while type(node) is list and node[0] < depth:
            parent, via = node, byte(s, node[0])
            node = node[1][via]
            node = node[0] if type(node) is tuple else node
        if type(node) is list and node[0] == depth:
            node[1][_free(node[1], byte(s, depth))] = (i,)
            continue
        branch = [depth, {}]
        branch[1][byte(other, depth)] = node if type(node) is list else (node,)
        branch[1][_free(branch[1], byte(s, depth))] = (i,)
        if parent is None:
            root = branch
        else:
            parent[1][via] = branch
    order, lcps, stack = [], [], [(root, 0)]
    while stack:
        node, lcp = stack.pop()
        if type(node) is not list:
            order.append(node[0] if type(node) is tuple else node)
            lcps.append(lcp)
            continue
        keys = sorted(node[1], key=lambda k: k if type(k) is int else k[0])
        for k in reversed(keys[1:]):
            stack.append((node[1][k], node[0]))
        stack.append((node[1][keys[0]], lcp))
    return order, lcps


def _free(children: dict, key: int) -> int | tuple:
    """The key; for one more string that is equal to a whole one, a place of its own beside it."""
    return key if key not in children else (key, len(children))


def deep_shallow(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[start:start+size] inside ascending groups, and each one's common prefix with the one before it (-1 where a group begins)."""
    n = len(start)
    order = np.argsort(group, kind="stable")
    g = group[order]
    lcp = np.full(n, -1, np.int64)
    lcp[1:][g[1:] == g[:-1]] = 0
    done = np.full(n, -1, np.int64)
    live = np.arange(n)  # places in order that aren't yet told apart from a neighbour
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for w in range(words):
        same = lcp[live] >= 0
        alone = ~same & ~np.append(same[1:] & (np.diff(live) == 1), False)
        live = live[~alone]
        if not len(live):
            break
        who = order[live]
        left = np.clip(size[who] - 8 * w, 0, 8)
        raw = padded[np.minimum(start[who] + 8 * w, len(data))[:, None] + np.arange(8)]
        raw = np.where(np.arange(8)[None, :] < left[:, None], raw, 0).astype(np.uint8)
        word = raw.view(">u8").ravel().astype(np.uint64)
        part = np.cumsum(lcp[live] < 0)
        by = np.lexsort((left, word, part))
        order[live], word, left, part = who[by], word[by], left[by], part[by]
        first = np.concatenate(([True], part[1:] != part[:-1]))
        differ = np.concatenate(([np.uint64(0)], word[1:] ^ word[:-1]))
        top = np.zeros(len(word), np.int64)
        high = differ.copy()
        for shift in (32, 16, 8):  # bytes below the highest that differs
            more = high >= np.uint64(1) << np.uint64(shift)
            top[more] += shift // 8
            high[more] >>= np.uint64(shift)
        equal = np.where(differ == 0, 8, 7 - top)
        shared = np.minimum(equal, np.minimum(left, np.concatenate(([0], left[:-1]))))
        lcp[live] = np.where(first, -1, 8 * w + shared)
        # those that agree in a full word go on, the others are done; a mark keeps the groups apart
        ongoing = ~first & (shared == 8)
        held = lcp[live].copy()
        held[~ongoing] = -1
        done[live[~ongoing & ~first]] = lcp[live[~ongoing & ~first]]
        lcp[live] = held
    final = np.where(done >= 0, done, lcp)
    same = lcp >= 0 if not words else lcp >= 8 * words
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    for a, b in zip((edge[::2] - 1).tolist(), edge[1::2].tolist(), strict=True):
        who = order[a:b]
        strings = [data[x + 8 * words : x + y].tobytes() for x, y in zip(start[who].tolist(), size[who].tolist(), strict=True)]
        by, lcps = blind_trie(strings)
        order[a:b] = who[by]
        final[a + 1 : b] = 8 * words + np.array(lcps[1:])
    return order, final


def compare(data: np.ndarray, start: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Document, tie, start and end of what is removed among stretches data[start:]; columns as in _STRETCH."""
    doc, tie, first, count, distance, low, high = (c.astype(np.int64) if c.dtype.itemsize < 8 else c for c in columns)
    n = len(doc)
    here = start + distance
    right = first + count + WIDTH - 1 - first - distance
    order, lcp = deep_shallow(data, here, right, np.zeros(n, np.int64), GRAM // 8)
    edge = lcp < GRAM
    same = np.empty(n, np.int64)
    same[order] = np.cumsum(edge)
    flipped, ends = _take(data, start, distance, True), np.cumsum(distance)
    order_l, lcp_l = deep_shallow(flipped, ends - distance, distance, same, 1)
    rank = np.empty(n, np.int64)
    place = np.lexsort((first + distance, tie, doc))
    fresh = np.concatenate(([True], (doc[place][1:] != doc[place][:-1]) | (tie[place][1:] != tie[place][:-1]) | ((first + distance)[place][1:] != (first + distance)[place][:-1])))
    rank[place] = np.cumsum(fresh)
    gone = np.zeros((STARTS, n), bool)
    r, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(STARTS):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some) < 2:
            continue
        r[order] = np.cumsum(lcp < WIDTH - o)
        left[order_l] = np.cumsum(lcp_l < o)
        key = r[some] * (n + 1) + left[some]
        by = np.lexsort((rank[some], key))
        k, at = key[by], rank[some][by]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(len(k)), 0))
        gone[o, some[by[at != at[head]]]] = True
    turn = np.diff(np.concatenate((np.zeros((1, n), np.int8), gone.view(np.int8), np.zeros((1, n), np.int8))), axis=0).T
    who, begin = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    spot = (first + distance)[who]
    return doc[who], tie[who].astype(np.uint32), spot - (end - 1), spot - begin + WIDTH


def _sort(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _gathered(batches):
            heads, bodies = [], []
            for r in rows:
                n, size = int.from_bytes(r[:8], "little"), int.from_bytes(r[8:16], "little")
                heads.append(_unpack(r[16 : 16 + n], _STRETCH))
                bodies.append(pa.Codec("zstd").decompress(r[16 + n :], size, asbytes=True))
            columns = [np.concatenate(x) for x in zip(*heads, strict=True)]
            size = columns[3].astype(np.int64) + WIDTH - 1
            yield from _spans(*compare(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(size) - size, columns), bits)

    return run


def removed(docs: DataFrame) -> C.Shelf:
    """The shelf of the spans to remove, by document key."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    rows = _with_id(docs.select("doc_id", "text")).drop("doc_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = C.bits_for(size, BUCKET_BYTES)
    n, asked, spans = 2**bits, C.shared_dir(spark, "suffix-dedup-asked"), C.shared_dir(spark, "suffix-dedup")
    found = rows.mapInArrow(C.trimmed(_find(bits)), ROWS).repartitionById(n, "bucket").mapInArrow(C.trimmed(_split(_judge(bits))), ROWS)
    found = C.stored(found, "suffix-dedup-found")
    kept = _shelf(found.filter("kind = 'ask'"), asked, "ask", _ASK, bits)
    more = rows.mapInArrow(C.trimmed(_read(kept, bits)), ROWS).repartitionById(n, "bucket").mapInArrow(C.trimmed(_sort(bits)), ROWS)
    out = _shelf(found.filter("kind = 'span'").unionByName(more), spans, "span", _SPAN, bits)
    C.drop_stored(found)
    C.discard(spark, asked)
    return out


def _split(judge: Callable) -> Callable:
    """Spans pass; anchors are judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                anchor = np.array([k == "anchor" for k in batch.column(0).to_pylist()], bool)
                if not anchor.all():
                    passed.append(batch.filter(pa.array(~anchor)))
                if anchor.any():
                    yield batch.filter(pa.array(anchor))

        passed: list[pa.RecordBatch] = []
        yield from judge(rest())
        yield from passed

    return run


def _cut(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    depth = np.zeros(len(text) + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    gone = np.cumsum(depth[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return text[~gone].tobytes(), int(gone.sum()), runs


def _apply(batch: pa.RecordBatch, kept: C.Shelf) -> Iterator[tuple[bytes, int, int, int]]:
    """Of each row the bytes that stay, how many go, in how many runs, and how many there were."""
    doc, tie, data, offsets = _columns(batch)
    who, (start, end) = kept.of(_key(doc, tie))
    order = np.argsort(who, kind="stable")
    who, start, end = who[order], start[order].astype(np.int64), end[order].astype(np.int64)
    cuts = np.searchsorted(who, np.arange(len(doc) + 1))
    for i in range(len(doc)):
        text = data[offsets[i] : offsets[i + 1]]
        a, b = cuts[i], cuts[i + 1]
        yield *((text.tobytes(), 0, 0) if a == b else _cut(text, start[a:b], end[a:b])), len(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    kept, kind = removed(docs), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(size, gone, runs, hashlib.sha256(rest).hexdigest()) for rest, gone, runs, size in _apply(batch, kept)]
            size, gone, runs, digests = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_id(docs.select("doc_id", "text")).mapInArrow(C.trimmed(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _with_id(docs: DataFrame) -> DataFrame:
    """The columns that _columns() reads, then doc_id and the others. A null id has a tie of its own, which sets it apart from the largest id."""
    names = [C.fresh(docs, c) for c in ("dedup_doc", "dedup_tie", "dedup_text")]
    none = F.col("doc_id").isNull()
    tie = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)) + F.when(none, F.lit(1 << 31)).otherwise(F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias(names[0]), tie.alias(names[1]), F.col("text").alias(names[2]), *(c for c in docs.columns if c != "text"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes removed from text; a character of which only some bytes stay becomes U+FFFD."""
    kept, wide = removed(docs), _with_id(docs)
    names = ["text", *(c for c in docs.columns if c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([rest.decode("utf-8", "replace") for rest, *_ in _apply(batch, kept)], pa.string())
            yield pa.RecordBatch.from_arrays([text, *(batch.column(k) for k in range(3, batch.num_columns))], names)

    return wide.mapInArrow(C.trimmed(run), docs.select(*names).schema).select(*docs.columns)
