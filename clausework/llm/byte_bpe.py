"""Byte-level BPE from a file of ranks, in two tiers.

Texts are cut into pre-tokens by a transducer over classes of characters. The first tier is a minimal perfect hash of the
vocabulary (hash and displace): its one slot tells which token a pre-token could be, and their bytes are compared, for a whole
block of texts at once. Pre-tokens that aren't tokens are misses: each distinct one of a block is merged by a heap of pairs over
linked bytes, lowest rank first and leftmost among equals. The hash is built on the driver and broadcast; its size is the vocabulary's.

Defined results: a null text is empty and has no tokens; repeated rows each have their row; an empty table gives no
rows; there are no special tokens, so their strings are ordinary text; ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .fst_count import LETTER, NUMBER, OTHER, QUOTE, SPACE, STMD, WHITE, E, L, PieceScanner, R, V, piece_transducer

#: Keys to a bucket of the perfect hash, displacements tried at once, misses that a worker remembers, bytes of the longest of them.
BUCKET_KEYS, TRIES, REMEMBERED, LONGEST = 4, 256, 400_000, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens of a file of ranks: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def spans_equal(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_start:a_start+size] is b[b_start:b_start+size], for each span; sizes are at least 1."""
    if not len(size):
        return np.zeros(0, bool)
    ends = np.cumsum(size)
    within = np.arange(ends[-1]) - np.repeat(ends - size, size)
    same = a[np.repeat(a_start, size) + within] == b[np.repeat(b_start, size) + within]
    return np.logical_and.reduceat(same, ends - size)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys, n slots."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // BUCKET_KEYS)
        bucket = self.bucket(keys)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = np.cumsum(size) - size
        self.shift, free = np.zeros(self.buckets, np.int64), np.ones(n, bool)
        single = []
        for b in np.argsort(-size, kind="stable").tolist():
            mine = keys[order[start[b] : start[b] + size[b]]]
            if len(mine) < 2:
                single += [b] * len(mine)
                continue
            d = 0
            while True:
                slots = np.sort(self.slot(mine[None, :], np.arange(d, d + TRIES)[:, None]), axis=1)
                fits = np.flatnonzero(free[slots].all(1) & (np.diff(slots, axis=1) > 0).all(1))
                if len(fits):
                    break
                d += TRIES
            self.shift[b] = d + fits[0]
            free[slots[fits[0]]] = False
        self.shift[single] = ~np.flatnonzero(free)  # a bucket of one key names its slot

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (C.mix(keys + shift.astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that isn't one of the n has some slot too."""
        shift = self.shift[self.bucket(keys)]
        return np.where(shift < 0, ~shift, self.slot(keys, np.maximum(shift, 0)))


def character_classes() -> np.ndarray:
    """The class of every code point, as the library that reads rank files has them: letters, numbers and white space change from one Unicode version to the next."""
    import tiktoken

    plain = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, out = "".join(map(chr, plain)), np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = bytes(tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for chars, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", SPACE)):
        out[[ord(x) for x in chars]] = kind
    return out


class Scanner(PieceScanner):
    """The pre-tokenizer over classes that are given."""

    def __init__(self, kind: np.ndarray):
        self.kind = kind
        self.step, self.says = piece_transducer()


class Codec:
    """Encodes and decodes blocks of texts."""

    def __init__(self, ranks: dict[bytes, int], kind: np.ndarray):
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must count up from 0 and hold every byte")
        self.kind = kind
        self.tokens = sorted(ranks, key=ranks.get)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        keys = C.span_hashes(C.prefix_hashes(self.data), self.start, self.start + self.size)
        self.hash = PerfectHash(keys)
        self.id_at = np.empty(len(keys), np.int64)
        self.id_at[self.hash.of(keys)] = np.arange(len(keys))
        digits = [b"%d " % i for i in range(len(keys))]
        self.digit_size = np.array([len(x) for x in digits], np.int64)
        self.digit_start, self.digits = np.cumsum(self.digit_size) - self.digit_size, np.frombuffer(b"".join(digits), np.uint8)
        self.known: dict[bytes, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def ready(self) -> Codec:
        """With what a worker needs besides."""
        if "ranks" not in self.__dict__:
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
            self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)])
            self.pair_rank = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
            self.scanner = Scanner(self.kind)
        return self

    def all_merged(self, pieces: list[bytes]) -> list[bytes]:
        """merged() of each piece."""
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        if not len(ends):
            return []
        data, starts = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.append(0, ends[:-1])
        rank = self.pair_rank[data[:-1] << 8 | data[1:]]
        pair = np.full(len(data), -1)
        pair[:-1] = np.where(rank < 0, -1, rank << 32 | (np.arange(len(rank)) - np.repeat(starts, ends - starts)[:-1]))
        pair[ends - 1] = -1
        pair, token, ends = pair.tolist(), self.byte_rank[data].tolist(), ends.tolist()
        return [self.merged(p, token[b - len(p) : b], pair[b - len(p) : b]) for p, b in zip(pieces, ends, strict=True)]

    def merged(self, piece: bytes, token: list[int], pair: list[int]) -> bytes:
        """The tokens of one pre-token as 32-bit numbers: a heap of pairs over linked bytes, each held as its rank above its place. token: the bytes' own; pair: their pairs."""
        n, rank, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part begins at i and ends where the next begins
        heap = [x for x in pair if x >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top:  # one of its parts has been merged meanwhile
                continue
            token[i] = top >> 32
            gone = behind[i]
            end = behind[i] = behind[gone]
            token[gone] = pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                r = rank(piece[i : behind[end]])
                if r is not None:
                    pair[i] = r << 32 | i
                    push(heap, pair[i])
            left = before[i]
            if left >= 0:
                r = rank(piece[left:end])
                if r is None:
                    pair[left] = -1
                else:
                    pair[left] = r << 32 | left
                    push(heap, pair[left])
        return array("I", [t for t in token if t >= 0]).tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[offsets[i]:offsets[i+1]], one behind the other, and where each text's begin."""
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        where = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        firsts = np.unique(offsets[:-1][offsets[:-1] < len(data)])
        start = where[self.scanner.starts(code, np.searchsorted(where, firsts))]
        size = np.diff(np.append(start, len(data)))
        keys = C.span_hashes(C.prefix_hashes(data), start, start + size)
        token = self.id_at[self.hash.of(keys)]
        could = np.flatnonzero(self.size[token] == size)
        hit = np.zeros(len(start), bool)
        hit[could] = spans_equal(data, start[could], self.data, self.start[token[could]], size[could])
        miss = np.flatnonzero(~hit)
        count = np.ones(len(start), np.int64)
        pieces, kind = self.misses(data, start[miss], size[miss], keys[miss])
        lengths = np.array([len(x) // 4 for x in pieces], np.int64)
        count[miss] = lengths[kind]
        ends = np.cumsum(count)
        out = np.empty(ends[-1], np.int64)
        out[(ends - 1)[hit]] = token[hit]
        if len(miss):
            flat, begins = np.frombuffer(b"".join(pieces), np.uint32), np.cumsum(lengths) - lengths
            n = count[miss]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat((ends - count)[miss], n) + within] = flat[np.repeat(begins[kind], n) + within]
        return out, np.append(0, ends)[np.searchsorted(start, offsets)]

    def misses(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of each distinct miss, and which of them each span is."""
        if not len(start):
            return [], np.empty(0, np.int64)
        _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        rep = first[kind]
        same = size == size[rep]
        same[same] = spans_equal(data, start[same], data, start[rep[same]], size[same])
        odd = np.flatnonzero(~same)  # equal hashes of different bytes
        kind[odd] = len(first) + np.arange(len(odd))
        raw, distinct = data.tobytes(), np.append(first, odd)
        pieces = [raw[a : a + n] for a, n in zip(start[distinct].tolist(), size[distinct].tolist(), strict=True)]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = [known.get(p) for p in pieces]
        fresh = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(fresh, self.all_merged([pieces[i] for i in fresh]), strict=True):
            out[i] = x
            if len(pieces[i]) <= LONGEST:
                known[pieces[i]] = x
        return out, kind

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one behind the other."""
        return self._joined(ids, self.size, self.start, self.data).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimals, a space behind each."""
        return self._joined(ids, self.digit_size, self.digit_start, self.digits).tobytes()

    @staticmethod
    def _joined(ids: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
        n = size[ids]
        ends = np.cumsum(n)
        return data[np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]


def _coded(codec, batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    """rows(codec, keys, ids, text's first ids) for whole texts of about BLOCK_BYTES at a time."""
    c = codec.value.ready()
    for batch in batches:
        data, offsets = C.text_bytes(batch.column(1))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + C.BLOCK_BYTES, "right")) - 1)
            ids, at = c.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield rows(c, batch.column(0).slice(i, j - i), ids, at)
            i = j


def _texts(key: str, c: Codec, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([keys, lists, pa.array([c.decode(ids[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], [key, "ids", "bytes"])


def _digests(key: str, c: Codec, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    said, text = [], []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        said.append(hashlib.sha256(c.decimal(ids[a:b])[:-1]).hexdigest())
        text.append(hashlib.sha256(c.decode(ids[a:b])).hexdigest())
    return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at)), pa.array(said, pa.string()), pa.array(text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])


def _mapped(docs: DataFrame, path: str, key: str, rows, schema: str) -> DataFrame:
    C.bound_batches(docs.sparkSession)
    codec = docs.sparkSession.sparkContext.broadcast(Codec(ranks_of(path), character_classes()))
    return docs.select(key, "text").mapInArrow(C.trimmed(lambda batches: _coded(codec, batches, partial(rows, key))), f"{key} {docs.schema[key].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """One row a document: key, ids array<int>, the bytes decoded from them."""
    return _mapped(docs, path, key, _texts, "ids array<int>, bytes binary")


def digest(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """encode() with digests in place of ids and bytes: key, n_tokens, ids_sha256 (decimals joined by a space), decoded_sha256."""
    return _mapped(docs, path, key, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
