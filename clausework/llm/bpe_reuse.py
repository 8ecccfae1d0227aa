"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes says so, so passages that documents share are cut alike. Each
distinct chunk is encoded once for as long as a task holds it, whatever document it comes from. A cut can fall inside
a token: so the stretch around each join is encoded again, together with a piece of either neighbour's that is encoded
already. Where its tokens begin and end with exactly those of the two pieces, what lies between stands; else the stretch
grows to the whole text. Pieces lie between safe places, where the
pre-tokenizer always starts anew, whatever stands around: before a space between two characters that aren't white space.
Inside a chunk, short pieces are looked up in a table of a worker's too. Decoding joins the bytes of the tokens.

Defined results: a null text is empty (no tokens); repeated rows each have their row; an empty table gives no rows;
special strings in a text become their ids, as the library's defaults have it; ids outside the vocabulary raise.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Bytes in a chunk on average, and of chunks that a task keeps.
CHUNK_BYTES, CACHE_BYTES = 1024, 24 << 20
#: Short pieces between safe places that a worker keeps.
PIECES = 200_000
_WINDOW = 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r" \s|\s ")
#: ByteLevel's alphabet: printable bytes stand for themselves, the others for the code points from 256 up.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as a byte-level BPE tokenizer file says."""

    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES, cache_bytes: int = CACHE_BYTES):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level tokenizers without a normalizer or prefix space")
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        order = {bytes(alphabet[c] for c in "".join(m if isinstance(m, list) else m.split(" "))): k for k, m in enumerate(spec["model"]["merges"])}
        merged = sorted((i, t) for t, i in ranks.items() if len(t) > 1)
        if [t for _, t in merged] != sorted(order, key=order.get):
            raise ValueError("ids must follow the order of the merges")
        self.special, self.chunk_bytes, self.cache_bytes = special, chunk_bytes, cache_bytes
        self.engine = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        known = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        table = [known.get(i, b"") for i in range(max(known) + 1)]
        self.size_of = np.array([len(t) for t in table], np.int64)
        self.starts_at = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.size_of)))[:-1]
        self.led_by_space = np.array([t.startswith(b" ") for t in table])
        self.all_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.cache: OrderedDict[str, tuple] = OrderedDict()
        self.pieces: dict[str, bytes] = {}
        self.held = self.hits = self.misses = self.regrown = 0

    def cuts(self, text: str) -> np.ndarray:
        """Where the chunks of a text end, in characters; the same bytes before a place give the same answer."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(code) <= _WINDOW:
            return np.array([len(code)])
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(code.astype(np.uint64)))))
        rolling = C.mix(prefix[_WINDOW:] - prefix[:-_WINDOW] + code[_WINDOW - 1 :].astype(np.uint64))
        at = np.flatnonzero(rolling % np.uint64(self.chunk_bytes) == 0) + _WINDOW
        return np.append(at[at < len(code)], len(code))

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text that stands between safe places, put together from its pieces between such places."""
        parts = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        head, more = self.engine_bytes(parts.pop(0)), self.pieces
        try:
            return np.frombuffer(head + b"".join(map(more.__getitem__, parts)), np.uint32)
        except KeyError:
            if len(more) > PIECES:
                more.clear()
            new = [p for p in set(parts).difference(more) if p]
            ids = np.frombuffer(self.engine_bytes(" " + " ".join(new)), np.uint32)
            at = np.flatnonzero(self.led_by_space[ids])
            if len(at) == len(new):  # each piece begins with the only token of its own that begins with a space
                raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                more.update((p, raw[i:j]) for p, i, j in zip(new, at, at[1:], strict=False))
            else:
                more.update((p, self.engine_bytes(" " + p)) for p in new)
            more[""] = self.engine_bytes(" ")
            out = np.frombuffer(head + b"".join(map(more.__getitem__, parts)), np.uint32)
            for p in parts if max(map(len, parts)) > 64 else ():
                if len(p) > 64:
                    more.pop(p, None)
            return out

    def engine_bytes(self, text: str) -> bytes:
        return array("I", self.engine.encode_ordinary(text)).tobytes() if text else b""

    def chunk(self, text: str) -> tuple:
        """A chunk's text before its first safe place, ids from there to the last one, text behind it, and the first and last piece between with their ids; without two such places, no ids."""
        found = self.cache.get(text)
        if found is not None:
            self.hits += 1
            self.cache.move_to_end(text)
            return found
        self.misses += 1
        safe = _SAFE.search(text)
        found = (text, None, None, None, None)
        if safe:
            first = safe.start()
            last = self.safe_before(text, len(text), first)
            found = (text[:first], None, text[last:], None, None)
            if last > first:
                left, right = text[first : _SAFE.search(text, first + 1).start()], text[self.safe_before(text, last, first) : last]
                found = (text[:first], self.plain(text[first:last]), text[last:], (left, self.engine_bytes(left)), (right, self.engine_bytes(right)))
        self.cache[text] = found
        self.held += 2 * len(text) + 400
        while self.held > self.cache_bytes:
            old, _ = self.cache.popitem(last=False)
            self.held -= 2 * len(old) + 400
        return found

    @staticmethod
    def safe_before(text: str, end: int, first: int) -> int:
        """The last safe place before end, but not before the safe place first."""
        back = text.rfind(" ", 0, end)
        while back > first and not _SAFE.match(text, back):
            back = text.rfind(" ", 0, back)
        return max(back, first)

    def ordinary(self, text: str) -> list[np.ndarray]:
        out, join, before, at = [], "", ("", b""), 0
        for end in self.cuts(text).tolist():
            head, ids, tail, left, right = self.chunk(text[at:end])
            at = end
            join += head
            if tail is None:  # no safe place: the stretch grows
                continue
            if ids is not None:
                between = self.repaired(before, join, left)
                if between is None:
                    return [self.whole(text)]
                out += [between, ids]
                join, before = tail, right
            else:
                join += tail
        between = self.repaired(before, join, ("", b""))
        return [self.whole(text)] if between is None else [*out, between]

    def repaired(self, before: tuple[str, bytes], join: str, behind: tuple[str, bytes]) -> np.ndarray | None:
        """The ids of a stretch around a join, if the tokens of the pieces on either side come out as they have before; else None."""
        if not join:
            return np.empty(0, np.uint32)
        raw = self.engine_bytes(before[0] + join + behind[0])
        head, tail = len(before[1]), len(raw) - len(behind[1])
        if head > tail or raw[:head] != before[1] or raw[tail:] != behind[1]:
            return None
        return np.frombuffer(raw[head:tail], np.uint32)

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text without any reuse."""
        self.regrown += 1
        return np.frombuffer(self.engine_bytes(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        out: list[np.ndarray] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
            elif part:
                out += self.ordinary(part)
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        size = self.size_of[ids]
        behind = np.cumsum(size)
        return self.all_bytes[np.repeat(self.starts_at[ids] - (behind - size), size) + np.arange(behind[-1])].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


@contextlib.contextmanager
def codec(path: str) -> Iterator[Codec]:
    """The process's codec for a file; its tables and short pieces are kept from task to task, its chunks are not."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    c = _CODECS[path]
    try:
        yield c
    finally:
        c.cache.clear()
        c.held = 0


def encode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """One row a document: key, ids array<int>, text decoded from them."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path) as c:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    ids = [c.encode(t or "") for t in batch.column(1).slice(i, 256).to_pylist()]
                    flat = np.concatenate(ids).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), lists, pa.array([c.decode(x) for x in ids])], [key, "ids", "text"])

    return docs.select(key, "text").mapInArrow(C.trimmed(run), f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, text string")


def digest(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """encode() with digests in place of ids and text: key, n_tokens, ids_sha256, decoded_sha256."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path) as c:
            for batch in batches:
                rows = []
                for text in batch.column(1):
                    ids = c.encode(text.as_py() or "")
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
                n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, "text").mapInArrow(C.trimmed(run), f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

