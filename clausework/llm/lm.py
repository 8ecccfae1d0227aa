"""LM scoring: an interpolated modified Kneser-Ney n-gram model of two or three words.

Three jobs read the training texts. The first counts words and gives each an id, small for frequent words; the others deal
out the distinct n-grams of some millions of tokens at a time, as sorted differences of ids, by a hash of two of their words:

* for three words, by the context, so that a bucket holds all followers of its contexts, and their counts of counts with it;
* by the last two words, so that a bucket holds all that stands before them: their continuation counts. What the words
  themselves need, as contexts and as continuations, is summed up in the bucket and sent on once more.

So a frequent word or n-gram is one record of a mapper, and no bucket gets more than its share. Each bucket becomes arrays in
the shared folder, sorted by 48 bits of the n-gram's hash beyond the bucket's own; counts and contexts' numbers are codes into
a small table of the bucket. Scorers memory-map the arrays and look up the distinct n-grams of a batch in sorted order.

Defined results: a null text is empty (one token, the end); a null doc_id counts as training; repeated rows count as
often as they occur; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

END = np.uint64(0xA076_1D64_78BD_642F)
_STEP = np.uint64(0xD6E8_FEB8_6659_FD93)
#: Tokens that a mapper counts together (below 2**21, as ids of words inside them have 21 bits), and bytes of text for each bucket of the model.
COUNT_TOKENS, BUCKET_BYTES = 2_000_000, 24 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "kind string, bucket int, payload binary"
#: Ids: what stands before a document, and a word that training has not seen; a word's id is its place in its bucket, from 1, times the buckets, plus the bucket.
BEGIN, UNKNOWN = np.uint32(0), np.uint32(2**32 - 1)


def batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch, each document followed by the end token, and each token's document."""
    data, offsets = C.text_bytes(column)
    hashes, docs = [], []
    for first, part, at in C.text_blocks(data, offsets):
        h, d = C.tokens(part, at)
        hashes.append(h)
        docs.append(d + first)
    n = len(offsets) - 1
    h = np.concatenate([*hashes, np.full(n, END)]) if n else np.empty(0, np.uint64)
    d = np.concatenate([*docs, np.arange(n)]).astype(np.int64) if n else np.empty(0, np.int64)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two ids; different pairs have different ones."""
    return C.mix(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))


def _pair_key(pair: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits of a pair's hash behind those of its bucket."""
    return pair << np.uint64(bits) >> np.uint64(16)


def _gram_key(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """48 bits of the hash of a pair and a word behind it."""
    return C.mix(pair * _STEP + word.astype(np.uint64)) >> np.uint64(16)


def before(ids: np.ndarray, docs: np.ndarray, back: int) -> np.ndarray:
    """The id of the token `back` places before each token in its document."""
    out = np.full(len(ids), BEGIN)
    out[back:] = np.where(docs[back:] == docs[:-back], ids[:-back], BEGIN)
    return out


def _pack(columns: list[np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(payload: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, size = int.from_bytes(payload[:8], "little"), int.from_bytes(payload[8:16], "little")
    raw, out, at = pa.Codec("zstd").decompress(payload[16:], size, asbytes=True), [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _pack_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, count: np.ndarray) -> bytes:
    """Distinct (a, b, c), ascending, and counts: differences, and the bytes of a value apart, which packs well."""
    n = len(a)
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    first, second, third, begins = a[new], b[new], c.copy(), np.zeros(n, bool)
    begins[new] = True
    third[1:] -= np.where(begins[1:], np.uint32(0), c[:-1])
    step = second.copy()
    step[1:] -= np.where(first[1:] == first[:-1], second[:-1], np.uint32(0))
    columns = [np.diff(first, prepend=np.uint32(0)), step, np.diff(np.append(new, n)).astype("u4"), third, count.astype("u4")]
    raw = b"".join(np.ascontiguousarray(x.astype("u4")).view("u1").reshape(-1, 4).T.tobytes() for x in columns)
    return b"".join(x.to_bytes(8, "little") for x in (n, len(new), len(raw))) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unpack_triples(payload: bytes) -> list[np.ndarray]:
    n, pairs, size = (int.from_bytes(payload[k : k + 8], "little") for k in (0, 8, 16))
    raw, at, out = pa.Codec("zstd").decompress(payload[24:], size, asbytes=True), 0, []
    for k in (pairs, pairs, pairs, n, n):
        out.append(np.ascontiguousarray(np.frombuffer(raw, "u1", 4 * k, at).reshape(4, k).T).view("u4").ravel())
        at += 4 * k
    first = np.cumsum(out[0], dtype=np.uint32)
    second = _running(out[1], np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))))
    starts = np.cumsum(out[2], dtype=np.int64) - out[2]
    return [np.repeat(first, out[2]), np.repeat(second, out[2]), _running(out[3], starts), out[4]]


def _running(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at starts."""
    total = np.cumsum(steps, dtype=np.uint64)
    offset = np.zeros(len(starts), np.uint64)
    offset[1:] = total[starts[1:] - 1]
    return (total - np.repeat(offset, np.diff(np.append(starts, len(steps))))).astype(np.uint32)


def _sums(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, ascending, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], ["kind", "bucket", "payload"])


def _stats(kind: str, bucket: int, counts: np.ndarray) -> pa.RecordBatch:
    """How many of the counts are 1, 2, 3 and 4, and 3 or more; how many there are, and their sum."""
    numbers = [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum()), len(counts), int(counts.sum())]
    return _batch([(f"stats-{kind}", bucket, json.dumps(numbers).encode())])


def _put_coded(name: str, values: list[np.ndarray]) -> None:
    """Columns of numbers as a code for each row and a table of the different rows."""
    key = np.zeros(len(values[0]), np.uint64)
    for v in values:
        key = C.mix(key + v.astype(np.uint64))
    _, first, code = np.unique(key, return_index=True, return_inverse=True)
    C.put_file(f"{name}.table", np.stack([v[first].astype(np.uint64) for v in values], 1).tobytes())
    C.put_file(f"{name}.code", code.astype(np.min_scalar_type(max(0, len(first) - 1))).tobytes())


def _map_coded(name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    table = C.map_file(f"{name}.table", "u8").reshape(-1, width)
    return table, C.map_file(f"{name}.code", np.min_scalar_type(max(0, len(table) - 1)).str)


def _put_keyed(name: str, keys: np.ndarray, values: list[np.ndarray]) -> None:
    """Ascending 48-bit keys and the columns of numbers beside them."""
    C.put_file(f"{name}.high", (keys >> np.uint64(16)).astype("u4").tobytes())
    C.put_file(f"{name}.low", keys.astype("u2").tobytes())
    _put_coded(name, values)


def _map_keyed(name: str, width: int) -> list[np.ndarray]:
    return [C.map_file(f"{name}.high", "u4"), C.map_file(f"{name}.low", "u2"), *_map_coded(name, width)]


def _whole_keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64)


def _places(high: np.ndarray, low: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Where the keys asked for stand, or -1."""
    top, rest = (ask >> np.uint64(16)).astype("u4"), ask.astype("u2")
    at, out = np.searchsorted(high, top), np.full(len(ask), -1)
    left = np.arange(len(ask))
    while len(left):  # keys that agree in their upper bits stand side by side
        left = left[at[left] < len(high)]
        left = left[high[at[left]] == top[left]]
        hit = low[at[left]] == rest[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
    return out


class Words:
    """Ids and counts of words by their hashes."""

    def __init__(self, folder: str, bits: int, there: bytes):
        self.folder, self.bits, self.there = folder, bits, there

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending hashes."""
        files = self.__dict__.setdefault("files", {})
        ids, counts = np.full(len(hashes), UNKNOWN), np.zeros(len(hashes), np.uint32)
        cuts = np.searchsorted(C.bucket_of(hashes, self.bits), np.arange(2**self.bits + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            if not self.there[b >> 3] >> (b & 7) & 1:
                continue
            if b not in files:
                files[b] = [C.map_file(f"{self.folder}/word-{b}.{x}", k) for x, k in (("hash", "u8"), ("place", "u4"), ("count", "u4"))]
            keys, place, count = files[b]
            ask = hashes[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == ask)
            ids[cuts[b] + hit] = place[at[hit]] * np.uint32(2**self.bits) + np.uint32(b)
            counts[cuts[b] + hit] = count[at[hit]]
        return ids, counts


def _mapper(flush: Callable[[np.ndarray, np.ndarray, int], Iterator[pa.RecordBatch]]) -> Callable:
    """flush of the hashes and documents of about COUNT_TOKENS tokens at a time, and how many of them only stand before the others, having been given already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut() -> Iterator[pa.RecordBatch]:
            h, d = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            step = -(-len(h) // -(-len(h) // COUNT_TOKENS))
            for at in range(0, len(h), step):  # a very long document goes on in the next part
                low = max(0, at - 2)
                yield from flush(h[low : at + step], d[low : at + step], at - low)

        base = 0
        for batch in batches:
            h, d = batch_tokens(batch.column(0))
            if len(h):
                held.append((h, d + base))
            base += batch.num_rows
            if sum(len(x) for x, _ in held) >= COUNT_TOKENS * 3 // 4:
                yield from cut()
        if held:
            yield from cut()

    return run


def _word_mapper(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            words, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.searchsorted(C.bucket_of(words, bits), np.arange(2**bits + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                yield _batch([("word", b, _pack([words[cuts[b] : cuts[b + 1]], count[cuts[b] : cuts[b + 1]].astype("u4")]))])

        for batch in batches:
            held.append(batch_tokens(batch.column(0))[0])
            if sum(map(len, held)) >= COUNT_TOKENS:
                yield from flush()
        if held:
            yield from flush()

    return run


def _rows_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[bytes]], list[pa.RecordBatch]]]:
    """Of each bucket its payloads by kind; rows of statistics come first, as they are, with bucket -1."""
    groups: dict[int, dict[str, list[bytes]]] = {}
    for batch in batches:
        for kind, bucket, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind.startswith("stats"):
                yield -1, {}, [_batch([(kind, bucket, payload)])]
            else:
                groups.setdefault(bucket, {}).setdefault(kind, []).append(payload)
    for bucket in sorted(groups):
        yield bucket, groups.pop(bucket), []


def _word_reducer(folder: str, bits: int) -> Callable:
    """Writes a bucket's words: hashes, ascending, and beside them their places by falling count, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, kinds, _ in _rows_by_bucket(batches):
            h, c = (np.concatenate(x) for x in zip(*(_unpack(r, ["u8", "u4"]) for r in kinds["word"]), strict=True))
            words, (count,) = _sums(h, [c])
            place = np.empty(len(words), "u4")
            place[np.argsort(-count.astype(np.int64), kind="stable")] = np.arange(1, len(words) + 1)
            if (len(words) + 1) << bits >= int(UNKNOWN):
                raise OverflowError("more words than ids of 32 bits")
            for x, v in (("hash", words), ("place", place), ("count", count.astype("u4"))):
                C.put_file(f"{folder}/word-{bucket}.{x}", v.tobytes())
            yield _stats("word", bucket, count)

    return run


def _gram_mapper(words: Words, turn: tuple[int, int, int | None], counted: bool, bits: int) -> Callable:
    """Distinct n-grams as (a, b, c): the words so many places back in `turn`, c 0 for None; dealt out by (a, b)."""

    def flush(h: np.ndarray, d: np.ndarray, skip: int) -> Iterator[pa.RecordBatch]:
        kinds, at = np.unique(h, return_inverse=True)
        ids = words.of(kinds)[0]
        local, at_local = np.unique(np.append(ids, BEGIN), return_inverse=True)  # ascending ids, so that their places sort as they do
        token = at_local[at].astype(np.uint64)
        back = lambda k: token if not k else np.concatenate((np.zeros(k, np.uint64), np.where(d[k:] == d[:-k], token[:-k], np.uint64(0))))[: len(token)]  # noqa: E731  BEGIN is the least id
        columns = [np.zeros(len(token), np.uint64) if k is None else back(k) for k in turn]
        key = (columns[0] << np.uint64(42) | columns[1] << np.uint64(21) | columns[2])[skip:]
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(new, len(key))).astype("u4") if counted else np.ones(len(new), "u4")
        key, mask = key[new], np.uint64(2**21 - 1)
        a, b, c = (local[(key >> np.uint64(s) & mask).astype(np.int64)] for s in (42, 21, 0))
        bucket = C.bucket_of(_pair_hash(a, b), bits)
        order = np.argsort(bucket.astype(np.min_scalar_type(2**bits)), kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(2**bits + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[k] : cuts[k + 1]]
            yield _batch([("gram", k, _pack_triples(a[some], b[some], c[some], count[some]))])

    return _mapper(flush)


def _merged(rows: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of a bucket's payloads: distinct pairs (a, b), ascending, the first triple of each, and c and count of the distinct triples."""
    a, b, c, count = (np.concatenate(x) for x in zip(*map(_unpack_triples, rows), strict=True))
    pairs, at = np.unique(a.astype(np.uint64) << np.uint64(32) | b, return_inverse=True)
    key = at.astype(np.uint64) << np.uint64(32) | c
    del a, b, c, at
    triples, (count,) = _sums(key, [count.astype(np.uint64)])
    first = np.searchsorted(triples >> np.uint64(32), np.arange(len(pairs), dtype=np.uint64))
    return pairs, first, triples.astype("u4"), count


def _context_numbers(count: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For runs of counts that begin at first: their sum, and how many are 1, 2, and 3 or more."""
    return [np.add.reduceat(x.astype(np.uint64), first) for x in (count, count == 1, count == 2, count >= 3)]


def _split_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> np.uint64(32)).astype("u4"), pairs.astype("u4")


def _gram_reducer(folder: str, bits: int) -> Callable:
    """Writes a bucket's n-grams of three words and their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, kinds, _ in _rows_by_bucket(batches):
            pairs, first, c, count = _merged(kinds["gram"])
            hashes = _pair_hash(*_split_pairs(pairs))
            keys = _gram_key(np.repeat(hashes, np.diff(np.append(first, len(c)))), c)
            order = np.argsort(keys)
            _put_keyed(f"{folder}/gram-{bucket}", keys[order], [count[order]])
            keys, numbers = _pair_key(hashes, bits), _context_numbers(count, first)
            order = np.argsort(keys)
            _put_keyed(f"{folder}/context-{bucket}", keys[order], [x[order] for x in numbers])
            yield _stats("gram", bucket, count)

    return run


def _pair_reducer(folder: str, bits: int, counted: bool, contexts: bytes | None) -> Callable:
    """Writes a bucket's pairs of words: their count, and the numbers of what follows them; sends on what their words need.

    The pairs' files take the place of those of the contexts, which are removed; a task that runs again finds them in the former.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, kinds, _ in _rows_by_bucket(batches):
            known = contexts is not None and contexts[bucket >> 3] >> (bucket & 7) & 1
            if "gram" not in kinds and not known:
                continue
            pairs, first, _, count = _merged(kinds["gram"]) if "gram" in kinds else [np.empty(0, np.uint64)] * 4
            c = np.add.reduceat(count if counted else np.ones(len(count), np.uint64), first) if len(first) else count
            a, b = _split_pairs(pairs)
            keys = _pair_key(_pair_hash(a, b), bits)
            order = np.argsort(keys)
            keys, numbers = keys[order], [c[order], *(np.zeros(len(keys), np.uint64) for _ in range(4))]
            if known:
                old, more = _contexts(folder, bucket)
                every = np.union1d(keys, old)
                wide = [np.zeros(len(every), np.uint64) for _ in range(5)]
                wide[0][np.searchsorted(every, keys)] = numbers[0]
                for w, m in zip(wide[1:], more, strict=True):
                    w[np.searchsorted(every, old)] = m
                keys, numbers = every, wide
            _put_keyed(f"{folder}/pair-{bucket}", keys, numbers)
            for x in ("code", "table", "low", "high") if known else ():
                C.drop_file(f"{folder}/context-{bucket}.{x}")
            yield _stats("pair", bucket, c)
            if not len(c):
                continue
            starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            yield from _word_rows("before", a[starts], _context_numbers(c, starts), bits)
            follow, (n,) = _sums(b, [np.ones(len(b), np.uint64)])
            yield from _word_rows("behind", follow, [n], bits)

    return run


def _contexts(folder: str, bucket: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and numbers of a bucket's contexts, from their own files or, once these are gone, the pairs'."""
    try:
        high, low, table, code = _map_keyed(f"{folder}/context-{bucket}", 4)
        return _whole_keys(high, low), list(np.asarray(table)[np.asarray(code)].T)
    except FileNotFoundError:
        high, low, table, code = _map_keyed(f"{folder}/pair-{bucket}", 5)
        keys, numbers = _whole_keys(high, low), list(np.asarray(table)[np.asarray(code)].T[1:])
        some = np.flatnonzero(numbers[0])
        return keys[some], [x[some] for x in numbers]


def _word_rows(kind: str, ids: np.ndarray, values: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    bucket = ids & np.uint32(2**bits - 1)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(2**bits + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        some = order[cuts[b] : cuts[b + 1]]
        columns = np.diff(ids[some] >> np.uint32(bits), prepend=np.uint32(0)), *(v[some] for v in values)
        yield _batch([(kind, b, _pack([x.astype("u8").view("u1").reshape(-1, 8).T.ravel() for x in columns]))])


def _unpack_words(payload: bytes, width: int) -> list[np.ndarray]:
    out = [np.ascontiguousarray(x.reshape(8, -1).T).view("u8").ravel() for x in _unpack(payload, ["u1"] * (width + 1))]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _single_reducer(folder: str) -> Callable:
    """Writes what a bucket's words are by themselves: a row for each place, of the distinct words before it and the numbers of what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, kinds, passed in _rows_by_bucket(batches):
            yield from passed
            if bucket < 0:
                continue
            summed = {}
            for kind, width in (("behind", 1), ("before", 4)):
                none = [np.empty(0, np.uint64)] * (width + 1)
                at, *values = [np.concatenate(x) for x in zip(none, *(_unpack_words(r, width) for r in kinds.get(kind, [])), strict=True)]
                summed[kind] = _sums(at, values)
            numbers = [np.zeros(1 + max(int(at[-1]) for at, _ in summed.values() if len(at)), np.uint64) for _ in range(5)]
            for (at, values), columns in ((summed["behind"], numbers[:1]), (summed["before"], numbers[1:])):
                for column, v in zip(columns, values, strict=True):
                    column[at.astype(np.int64)] = v
            _put_coded(f"{folder}/single-{bucket}", numbers)
            yield _stats("single", bucket, numbers[0][numbers[0] > 0])

    return run


class Discounts:
    """Modified Kneser-Ney's discounts for counts 1, 2 and 3 or more, from the counts of counts."""

    def __init__(self, n1: int, n2: int, n3: int, n4: int):
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        self.d = np.array([0.0, *(min(max(x, 0.0), k) for k, x in zip((0.95, 1.9, 2.85), raw, strict=True))])

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(counts, 3).astype(np.int64)]


class Model:
    """Where the arrays are, and the numbers that go with them; workers open the arrays on first use.

    there: for each table, a bit for each bucket that has been written; a missing file of one of them is an error.
    """

    def __init__(self, folder: str, order: int, bits: int, stats: dict[str, list[int]], there: dict[str, bytes]):
        self.folder, self.order, self.bits, self.stats, self.there = folder, order, bits, stats, there
        self.n_tokens, self.n_words = stats.get("word", [0] * 7)[6], stats.get("word", [0] * 7)[5]
        self.words = Words(folder, bits, there.get("word", bytes(2**bits // 8 + 1)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def table(self, kind: str, b: int, read: Callable) -> list | None:
        files = self.__dict__.setdefault("files", {})
        if (kind, b) not in files:
            bits = self.there.get(kind)
            files[kind, b] = read(f"{self.folder}/{kind}-{b}") if bits and bits[b >> 3] >> (b & 7) & 1 else None
        return files[kind, b]

    def keyed(self, kind: str, width: int, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """len(keys) x width numbers; 0 where a key isn't."""
        if self.bits <= 16:
            both = bucket.astype(np.uint64) << np.uint64(48) | keys
            order = np.argsort(both)
            both = both[order]
            fresh = np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]
        else:
            order = np.lexsort((keys, bucket))
            fresh = np.concatenate(([True], (np.diff(keys[order]) != 0) | (np.diff(bucket[order]) != 0)))[: len(keys)]
        ask, where = order[fresh], np.cumsum(fresh) - 1
        out = np.zeros((len(ask), width))
        cuts = np.searchsorted(bucket[ask], np.arange(2**self.bits + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            if (files := self.table(kind, b, lambda name: _map_keyed(name, width))) is not None:
                high, low, table, code = files
                at = _places(high, low, keys[ask[cuts[b] : cuts[b + 1]]])
                hit = np.flatnonzero(at >= 0)
                out[cuts[b] + hit] = table[code[at[hit]]]
        wide = np.empty(len(keys), np.int64)
        wide[order] = where
        return out[wide]

    def single(self, ids: np.ndarray) -> np.ndarray:
        """len(ids) x 5 numbers of words by themselves."""
        out = np.zeros((len(ids), 5))
        bucket, place = ids & np.uint32(2**self.bits - 1), ids >> np.uint32(self.bits)
        for b in np.unique(bucket[ids != UNKNOWN]).tolist():
            if (files := self.table("single", b, lambda name: _map_coded(name, 5))) is not None:
                table, code = files
                mine = np.flatnonzero((bucket == b) & (ids != UNKNOWN) & (place < len(code)))
                out[mine] = table[code[place[mine]]]
        return out

    def score(self, h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, and its count in training."""
        kinds, at = np.unique(h, return_inverse=True)
        ids, count = self.words.of(kinds)
        alone = self.single(np.append(ids, BEGIN))
        word = ids[at]
        n1, n2, n3, n4, more, _, total = self.stats.get("single", [0] * 7)
        p = np.full(len(kinds), 1.0 / (self.n_words + 1))
        if total:
            c, cut = alone[:-1, 0], Discounts(n1, n2, n3, n4)
            p = np.maximum(c - cut(c), 0) / total + (cut.d[1:] @ [n1, n2, more]) / total * p
        p = p[at]
        if "pair" in self.stats:
            last = before(word, d, 1)
            place = np.full(len(word), len(kinds))  # BEGIN's row
            place[1:] = np.where(d[1:] == d[:-1], at[:-1], len(kinds))
            begin = np.array([BEGIN])
            pair = _pair_hash(np.concatenate((last, begin)), np.concatenate((word, begin)))
            found = self.keyed("pair", 5, C.bucket_of(pair, self.bits), _pair_key(pair, self.bits))
            found[:-1][(last == UNKNOWN) | (word == UNKNOWN)] = 0
            p = self.mixed("pair", p, found[:-1, 0], alone[place, 1:])
            if "gram" in self.stats:
                context = np.full(len(word), len(word))  # BEGIN twice
                context[1:] = np.where(d[1:] == d[:-1], np.arange(len(word) - 1), len(word))
                ours = pair[context]
                c = self.keyed("gram", 1, C.bucket_of(ours, self.bits), _gram_key(ours, word))[:, 0]
                c[(word == UNKNOWN) | (found[context, 1] == 0)] = 0
                p = self.mixed("gram", p, c, found[context, 1:])
        return np.log10(p), count[at]

    def mixed(self, level: str, lower: np.ndarray, c: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Discounted counts over their contexts' sums, and the rest of the mass by the lower order; that alone without a context."""
        cut, total = Discounts(*self.stats[level][:4]), context[:, 0]
        free = context[:, 1:] @ cut.d[1:]
        return np.where(total > 0, (np.maximum(c - cut(c), 0) + free * lower) / np.maximum(total, 1), lower)


def fit(docs: DataFrame, order: int = 3) -> Model:
    """Count the texts of docs (column text) into a model of two or three words in the shared folder."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    C.bound_batches(spark)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # no job here reads another's shuffle
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = C.bits_for(size, BUCKET_BYTES, 3)
    folder = C.shared_dir(spark, "kneser-ney")
    stats: dict[str, list[int]] = {}
    there: dict[str, bytes] = {}

    def run(*steps: Callable) -> None:
        """A mapper and reducers, with rows dealt out by bucket between them, and one for each bucket besides; sums up the numbers, and notes which buckets there are."""
        rows = docs.select("text").mapInArrow(C.trimmed(steps[0]), ROWS)
        if len(steps) > 2:
            rows = rows.unionByName(spark.range(2**bits).select(F.lit("every").alias("kind"), F.col("id").cast("int").alias("bucket"), F.lit(None).cast("binary").alias("payload")))
        for step in steps[1:]:
            rows = rows.repartitionById(2**bits, "bucket").mapInArrow(C.trimmed(step), ROWS)
        out = C.stored(rows, "kneser-ney-numbers")
        some = out.select("kind", "bucket", F.from_json(F.col("payload").cast("string"), "array<long>").alias("s"))
        for r in some.groupBy("kind").agg(*(F.sum(F.get("s", k)) for k in range(7))).collect():  # a row for each kind
            kind = r["kind"].removeprefix("stats-")
            stats[kind], there[kind] = list(r[1:]), C.present(some.filter(F.col("kind") == r["kind"]), 2**bits)
        C.drop_stored(out)

    run(_word_mapper(bits), _word_reducer(folder, bits))
    words = Words(folder, bits, there.get("word", bytes(2**bits // 8 + 1)))
    if order == 3:
        run(_gram_mapper(words, (2, 1, 0), True, bits), _gram_reducer(folder, bits))
        last = _gram_mapper(words, (1, 0, 2), False, bits)
    else:
        last = _gram_mapper(words, (1, 0, None), True, bits)
    run(last, _pair_reducer(folder, bits, order == 2, there.get("gram")), _single_reducer(folder))
    spark.conf.set(_CLEANUP, was)
    return Model(folder, order, bits, stats, there)


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """One row a document: the key, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    C.bound_batches(docs.sparkSession)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            h, d = batch_tokens(batch.column(1))
            logs, count = model.score(h, d)
            size = np.bincount(d, minlength=n)
            base = np.log10((count + 1.0) / (model.n_tokens + model.n_words + 1.0))
            total = np.bincount(d, logs, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (size, np.bincount(d, count > 0, n).astype(np.int64), np.full(n, model.n_tokens, np.int64), np.bincount(d, base, n), total, 10.0 ** (-total / np.maximum(size, 1))))],
                [key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return docs.select(key, "text").mapInArrow(C.trimmed(run), schema)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key's text leaves the remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))
