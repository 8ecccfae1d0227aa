"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic transducers count the tokens of a text without making them.

* The pre-tokenizer's transducer has fifteen states over eleven classes of characters; its transitions say where pieces
  begin. A text is cut into chunks; each chunk's map from the state before it to the state behind it is built for all
  chunks at once, a column of characters at a time; the maps compose through a parallel prefix scan; then every chunk
  runs from its own known state.
* The BPE transducer reads the bytes of a piece. Each transition is annotated with the number of tokens by which the
  encoding of the bytes read grows or shrinks. A state holds what can still matter: every place before which a token may
  yet begin (its node in the trie of tokens), the token that ends there, and the count there against the count here. A
  token follows another exactly if BPE leaves the two as they are, so each state has one next state. States are
  compiled when first reached and kept in dense tables that all pieces of a block run through together; tables that
  grow beyond MAX_STATES are dropped and built anew.

Defined results: a null text has no bytes and no tokens; special strings in a text count one token, as the library's
defaults have it; repeated rows each have their row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .bpe_reuse import byte_alphabet

#: Characters in a chunk, states of the BPE transducer that are kept, distinct pieces that run together.
CHUNK, MAX_STATES, PIECES = 128, 32_000, 1 << 16
#: Tokens below a node of the trie up to which tokens before it are told apart only by which of these can follow.
FEW = 256
#: Bits of what a transition says: a piece begins before this character, before the one before it.
HERE, BACK = 1, 2
LETTER, STMD, R, V, L, E, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(11)
START, WORD, DIGITS, MARKS, ONE_SPACE, ONE_WHITE, SPACES, WHITES, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
N_CLASSES, N_STATES = 11, 12


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
        elif kind == "Z" or 9 <= c <= 13 or c == 0x85:
            out[c] = WHITE
    for chars, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", SPACE)):
        out[[ord(x) for x in chars]] = kind
    return out


def piece_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for [state, class]; classes from N_CLASSES on are those of the first character of a text."""
    step, says = np.zeros((N_STATES, 2 * N_CLASSES), np.uint8), np.zeros((N_STATES, 2 * N_CLASSES), np.uint8)
    letters = (LETTER, STMD, R, V, L, E)
    fresh = {c: WORD for c in letters} | {NUMBER: DIGITS, OTHER: MARKS, QUOTE: QUOTED, SPACE: ONE_SPACE, WHITE: ONE_WHITE}
    joined = fresh | {QUOTE: MARKS}  # behind a space that belongs to the piece
    for c in range(N_CLASSES):
        blank = c in (SPACE, WHITE)
        for state, same in ((START, ()), (WORD, letters), (DIGITS, (NUMBER,)), (MARKS, (OTHER, QUOTE)), (QUOTED, (OTHER, QUOTE))):
            step[state, c], says[state, c] = ((MARKS if state == QUOTED else state), 0) if c in same else (fresh[c], HERE)
        for state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
            if blank:
                step[state, c] = SPACES if c == SPACE else WHITES
            elif state in (ONE_SPACE, SPACES):
                step[state, c], says[state, c] = joined[c], BACK * (state == SPACES)
            else:
                step[state, c], says[state, c] = fresh[c], HERE | BACK * (state == WHITES)
        for state in (QUOTE_R, QUOTE_V, QUOTE_L):
            step[state, c], says[state, c] = (WORD, BACK) if c in letters else (fresh[c], HERE | BACK)
    for state, c, to in ((QUOTED, STMD, START), (QUOTED, R, QUOTE_R), (QUOTED, V, QUOTE_V), (QUOTED, L, QUOTE_L), (QUOTE_R, E, START), (QUOTE_V, E, START), (QUOTE_L, L, START)):
        step[state, c], says[state, c] = to, 0
    for state in range(N_STATES):
        step[state, N_CLASSES:] = step[START, :N_CLASSES]
        says[state, N_CLASSES:] = HERE | BACK * (state in (QUOTE_R, QUOTE_V, QUOTE_L))
    return step, says


class PieceScanner:
    def __init__(self) -> None:
        self.kind = classes()
        self.step, self.says = piece_transducer()

    def starts(self, code: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pieces begin among the code points of texts that begin at firsts."""
        n = len(code)
        kind = self.kind[code]
        kind[firsts] += N_CLASSES
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, LETTER, np.uint8)
        grid[:n] = kind
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)  # a column of characters is a row here
        flat, width = self.step.ravel(), 2 * N_CLASSES
        maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], rows, 1)
        for column in grid:
            maps = flat[maps.astype(np.int16) * width + column]
        scan, d = maps, 1
        while d < rows:  # scan[:, i] composes the maps of chunks i-d+1 to i, then of twice as many
            scan = np.concatenate((scan[:, :d], np.take_along_axis(scan[:, d:], scan[:, :-d].astype(np.int64), 0)), axis=1)
            d *= 2
        state = np.concatenate((np.zeros(1, np.uint8), scan[START, :-1]))
        said = np.empty_like(grid)
        loud = self.says.ravel()
        for k, column in enumerate(grid):
            at = state.astype(np.int16) * width + column
            said[k], state = loud[at], flat[at]
        said = said.T.ravel()
        begins = (said[:n] & HERE) > 0
        begins[:-1] |= (said[1:n] & BACK) > 0
        last = int(scan[START, -1]) if n == rows * CHUNK else None
        if last is None:  # the grid is filled up with letters: what the first of them says tells how the text ended
            begins[-1] |= bool(said[n] & BACK) and kind[-1] in (R, V, L)
        else:
            begins[-1] |= last in (QUOTE_R, QUOTE_V, QUOTE_L)
        return np.flatnonzero(begins)


class BpeTransducer:
    """Counts the tokens of pieces given as bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level tokenizers without a normalizer or prefix space")
        alphabet = byte_alphabet()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        known = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in known}
        self.bytes_of = {i: t for t, i in ranks.items()}
        engine = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merge = engine._core_bpe.encode_single_piece
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                to = self.children[node].get(b)
                if to is None:
                    to = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.below: list[list[int] | None] = [None] * len(self.children)  # tokens in the node's subtree, where they are few
        for node in range(len(self.children) - 1, -1, -1):  # children have larger numbers
            parts = [self.below[to] for to in self.children[node].values()]
            tokens = None if None in parts else [x for to, some in zip(self.children[node].values(), parts, strict=True) for x in ([self.token[to]] if self.token[to] >= 0 else []) + some]
            self.below[node] = tokens if tokens is not None and len(tokens) <= FEW else None
        self.pairs: dict[int, bool] = {}
        self.stand_in: dict[int, int | None] = {}
        self.first_with: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.of: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((4096, 256), -1, np.int32)
        self.emits = np.zeros((4096, 256), np.int8)
        self.state(((0, -1, 0),))
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        if len(self.stand_in) > 200_000:
            self.stand_in.clear()
            self.first_with.clear()

    def state(self, s: tuple) -> int:
        i = self.of.get(s)
        if i is None:
            i = self.of[s] = len(self.states)
            self.states.append(s)
            if i == len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.emits = np.concatenate((self.emits, np.zeros_like(self.emits)))
        return i

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a before token b as they are."""
        if a < 0:
            return True
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def alike(self, node: int, before: int) -> int | None:
        """A token that stands for `before` here, since the same tokens below the node can follow it; None if none can."""
        some = self.below[node]
        if some is None or before < 0:
            return before
        key = node << 24 | before
        if key not in self.stand_in:
            merge, old, of = self.merge, self.bytes_of[before], self.bytes_of
            can = [t for t in some if merge(old + of[t]) == [before, t]]
            name = hashlib.blake2b(array("I", [node, *can]).tobytes(), digest_size=16).digest()
            self.stand_in[key] = self.first_with.setdefault(name, before) if can else None
        return self.stand_in[key]

    def compile(self, at: int, byte: int) -> None:
        live, last, count = [], -1, 0
        for node, before, behind in self.states[at]:
            to = self.children[node].get(byte)
            if to is None:
                continue
            if self.token[to] >= 0 and last < 0 and self.follows(before, self.token[to]):
                last, count = self.token[to], behind + 1
            if self.children[to] and (before := self.alike(to, before)) is not None:
                live.append((to, before, behind))
        to = self.state((*((node, before, behind - count) for node, before, behind in live), (0, last, 0)))
        self.next[at, byte], self.emits[at, byte] = to, count

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:start+size]."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        alive = len(start)
        for k in range(int(size[0]) if len(size) else 0):
            alive = int(np.searchsorted(-size[:alive], -k, "left"))
            at = state[:alive] * 256 + data[start[:alive] + k]
            to = self.next.ravel()[at]
            if (to < 0).any():
                for x in np.unique(at[to < 0]).tolist():
                    self.compile(*divmod(x, 256))
                if len(self.states) > MAX_STATES:
                    self.clear()
                    half = len(start) // 2
                    if half:
                        out = np.concatenate((self.run(data, start[:half], size[:half]), self.run(data, start[half:], size[half:])))
                    else:
                        out = np.array([self.walk(data[start[0] : start[0] + size[0]])])
                    back = np.empty_like(out)
                    back[order] = out
                    return back
                to = self.next.ravel()[at]
            count[:alive] += self.emits.ravel()[at]
            state[:alive] = to
        out = np.empty_like(count)
        out[order] = count
        return out

    def walk(self, data: np.ndarray) -> int:
        """One piece, however many states it needs."""
        at = total = 0
        for b in data.tolist():
            if self.next[at, b] < 0:
                self.compile(at, b)
            total, at = total + int(self.emits[at, b]), int(self.next[at, b])
            if len(self.states) > MAX_STATES:
                here = self.states[at]
                self.clear()
                at = self.state(here)
        return total


class Counter:
    def __init__(self, path: str):
        self.scanner, self.bpe = PieceScanner(), BpeTransducer(path)
        self.special = re.compile(b"|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True)))) if self.bpe.special else None

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document data[offsets[i]:offsets[i+1]]."""
        n = len(offsets) - 1
        out = np.zeros(n, np.int64)
        if not len(data):
            return out
        raw = data.tobytes()
        cuts, skip = offsets[:-1], []
        found = [m.span() for m in self.special.finditer(raw)] if self.special else []
        found = [(a, b) for a, b in found if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b - 1, "right")]
        for a, b in found:
            out[np.searchsorted(offsets, a, "right") - 1] += 1
            skip.append(a)
        if found:
            cuts = np.unique(np.concatenate((cuts, *([a, b] for a, b in found))))
        cuts = np.unique(cuts[cuts < len(data)])
        lead = (data & 0xC0) != 0x80
        where = np.flatnonzero(lead)  # the byte at which each code point begins
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        start = where[self.scanner.starts(code, np.searchsorted(where, cuts))]
        end = np.append(start[1:], len(data))
        if found:
            inside = np.searchsorted(np.array(skip), start, "right") - 1
            keep = (inside < 0) | (start >= np.array([b for _, b in found])[inside])
            start, end = start[keep], end[keep]
        h = C.span_hashes(C.prefix_hashes(data), start, end)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        counts = np.concatenate([self.bpe.run(data, start[x], (end - start)[x]) for x in (first[i : i + PIECES] for i in range(0, len(first), PIECES))]) if len(first) else np.empty(0, np.int64)
        return out + np.bincount(np.searchsorted(offsets, start, "right") - 1, counts[back], n).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id") -> DataFrame:
    """One row a document: key, n_bytes, n_tokens, over_limit."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            i, counts = 0, np.zeros(batch.num_rows, np.int64)
            while i < batch.num_rows:  # whole documents, about BLOCK_BYTES at a time
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + C.BLOCK_BYTES, "right")) - 1)
                counts[i:j] = c.count(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, "text").mapInArrow(C.trimmed(run), f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
