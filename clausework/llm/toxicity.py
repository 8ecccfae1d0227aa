"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel counts common subsequences of ORDER characters, each occurrence weighted by DECAY to the power of the span it
takes, up to SPAN characters: characters that are put in between, or letters set apart, cost a little weight and break
nothing. Landmarks are short strings that set the sentences of toxic documents apart. The machine is trained on the
coordinates that the landmarks' kernel matrix gives a sentence. A sentence here is a stretch of REACH characters; which
stretch of a toxic document is the toxic one is where the landmarks themselves stand at first, and is chosen again in each
round by the machine; the worst stretches of other documents in all rounds so far are the negatives. As the decision is linear in the kernel to
the landmarks, and the kernel is a sum over subsequences, the machine is one weight for each subsequence: a text is
scored exactly, at every place, by looking up the subsequences that begin there. A document's score is a logistic
function of its highest stretches and the logarithm of its length (the highest of more stretches is higher), fitted on
documents of all lengths that the machine has not seen.

It is fitted on up to POSITIVE toxic and NEGATIVE other labelled documents (labelled.sample), which is the bound of
what the driver holds; everything is scored.

Defined results: a null text is empty and has the score of a text without any hint; repeated rows each have their row;
without labels of both kinds every score is the share of toxic labels, by the rule of succession; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

ORDER, SPAN, DECAY = 3, 6, 0.8
#: Lengths of stretches; characters between documents when many are scored together.
REACH, SHORT, APART = 11, 5, 16
LANDMARKS, ROUNDS, POSITIVE, NEGATIVE = 300, 4, 1_500, 3_000
#: Characters of a document that is fitted on, on average; longer than the second only where others are too few (labelled.sample).
LONGEST, FIRST = 3_000, 60_000
#: Between these the length counts; beyond them as these.
LENGTHS = 500, 20_000
#: Characters on either side by which a copy is told.
AROUND = 8
#: Characters that are scored together, and documents that a round looks at together.
BLOCK, TOGETHER = 1 << 20, 256
_MARK, _BETWEEN = 63, ""
_GAPS = [(a, b) for a, b in combinations(range(1, SPAN), ORDER - 1)]


def alphabet() -> np.ndarray:
    """A code below 64 for each code point: 0 for what parts words, 1-26 for letters of either case, others by a rule, 63 between documents."""
    out = np.zeros(0x110000, np.uint8)
    for c in (*range(0x250), *range(0x370, 0x590)):
        ch = chr(c).lower()
        if len(ch) == 1 and ch.isalpha():
            out[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) * 7 % 36
    out[0x590:0xD800] = 27 + np.arange(0x590, 0xD800) * 7 % 36
    out[[*range(0x2000, 0x2070), *range(0x3000, 0x3010)]] = 0
    out[ord(_BETWEEN)] = _MARK
    return out


_CODES: list[np.ndarray] = []


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts set APART marks apart, with runs of 0 as one 0, and none between letters that stand alone ("i d i o t"); where each begins."""
    if not _CODES:
        _CODES.append(alphabet())
    joined = (_BETWEEN * APART).join([*(t.replace(_BETWEEN, " ") for t in texts), ""])
    code = _CODES[0][np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    size = np.fromiter((len(t) + APART for t in texts), np.int64, len(texts))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    place = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    code, start = code[keep], place[np.cumsum(size) - size]
    letter = (code > 0) & (code < _MARK)
    alone = letter & ~np.concatenate(([False], letter[:-1])) & ~np.concatenate((letter[1:], [False]))
    keep = np.ones(len(code), bool)
    keep[1:-1] = ~((code[1:-1] == 0) & alone[:-2] & alone[2:])
    place = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    return code[keep], place[start]


def _triples(code: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each pattern of gaps: its weight, and the subsequence that begins at each place (len(code) - SPAN + 1 of them)."""
    n = len(code) - SPAN + 1
    x = code.astype(np.int32)
    high, middle = x << 12, x << 6
    for a, b in _GAPS:
        yield DECAY ** (b + 1), high[:n] + middle[a : a + n] + x[b : b + n]


def stretches(code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value for the SHORT and the REACH places from each place on."""
    n = max(0, len(code) - SPAN + 1)
    value = np.zeros(n + 1)
    if n:
        f = np.zeros(n, np.float32)
        for w, u in _triples(code):
            f += np.float32(w) * weights[u]
        value[1:] = np.cumsum(f, dtype=np.float64)
    total = np.concatenate((value, np.full(REACH, value[-1])))
    return (total[SHORT : SHORT + n] - total[:n]).astype(np.float32), (total[REACH : REACH + n] - total[:n]).astype(np.float32)


def _profile(code: np.ndarray, at: np.ndarray, dims: np.ndarray, size: int = REACH) -> np.ndarray:
    """Weights of the subsequences dims (ascending) in the stretches that begin at `at`: a row each."""
    out = np.zeros((len(at), len(dims)), np.float32)
    padded = np.concatenate((code, np.full(size + SPAN, _MARK, np.uint8)))
    spots = padded[at[:, None] + np.arange(size + SPAN)].astype(np.int32)
    for a, b in _GAPS:
        u = (spots[:, :size] << 12) + (spots[:, a : a + size] << 6) + spots[:, b : b + size]
        k = np.minimum(np.searchsorted(dims, u), len(dims) - 1)
        row, col = np.nonzero(dims[k] == u)
        np.add.at(out, (row, k[row, col]), DECAY ** (b + 1))
    return out


def _landmarks(code: np.ndarray, start: np.ndarray, toxic: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Strings inside words, with their ends, that occur in toxic documents more than in others, and by how much."""
    bad = np.repeat(toxic, np.diff(np.append(start, len(code))))
    good = (code > 0) & (code < _MARK)
    around = np.zeros(len(code), np.uint32)  # of what stands before and behind, so that copies count once
    padded = np.concatenate((np.zeros(AROUND, np.uint8), code, np.zeros(AROUND + 8, np.uint8))).astype(np.uint32)
    for k in range(AROUND):
        around *= np.uint32(1_000_003)
        around += padded[k : k + len(code)] * np.uint32(64)
        around += padded[AROUND + 8 + k : AROUND + 8 + k + len(code)]
    around = (around >> np.uint32(12)).astype(np.uint16)
    del padded
    found: list[tuple[float, int, int]] = []
    for n in (4, 5, 6, 7):
        m = len(code) - n + 1
        gram, whole = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(n):
            gram <<= 6
            gram |= code[k : k + m]
            whole &= good[k : k + m] | ((k in (0, n - 1)) & (code[k : k + m] == 0))  # words' ends count as characters
        places = gram[whole] << 17
        del gram
        places |= around[:m][whole].astype(np.int64) << 1
        places |= bad[:m][whole]
        places.sort()
        places = places[np.concatenate(([True], places[1:] != places[:-1]))]
        places = places[np.concatenate(([True], places[1:] >> 1 != places[:-1] >> 1))]  # not toxic where some document with it isn't
        kinds, first = np.unique(places >> 17, return_index=True)
        pos = np.add.reduceat(places & 1, first) if len(first) else first
        size = np.diff(np.append(first, len(places)))
        share = max(1e-3, (places & 1).mean()) if len(places) else 0.5
        some = (pos >= 3) & (pos / size > share)
        kinds, pos, neg = kinds[some], pos[some], (size - pos)[some]
        gain = pos * np.log(pos / (pos + neg) / share) + np.where(neg > 0, neg * np.log(np.maximum(neg, 1) / (pos + neg) / (1 - share)), 0)
        gain[gain < np.log(1 + (size >= 3).sum())] = 0  # as likely as not by chance among so many strings
        best = np.argsort(-gain, kind="stable")[:LANDMARKS]
        found += [(float(gain[i]), n, int(kinds[i])) for i in best if gain[i] > 0]
    found.sort(key=lambda x: (-x[0], x[1], x[2]))
    found = found[:LANDMARKS]
    strings = [np.array([g >> 6 * (n - 1 - k) & 63 for k in range(n)], np.uint8) for _, n, g in found]
    return strings, np.array([g for g, _, _ in found])


def _occurrences(code: np.ndarray, strings: list[np.ndarray], gain: np.ndarray) -> np.ndarray:
    """For each place, the gains of the strings that stand in the REACH places from it on, each as a part of its length times the longest."""
    value = np.zeros(len(code) + 1)
    for n in sorted({len(s) for s in strings}):
        mine = [k for k, s in enumerate(strings) if len(s) == n]
        number = lambda x: int("".join(f"{int(c):06b}" for c in x), 2)
        order = sorted((number(strings[k]), float(gain[k])) for k in mine)
        keys, gains = np.array([x for x, _ in order]), np.array([g for _, g in order])
        gram = np.zeros(max(0, len(code) - n + 1), np.int64)
        for k in range(n):
            gram = gram << 6 | code[k : k + len(gram)]
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == gram)
        value[1 + hit] = np.maximum(value[1 + hit], gains[at[hit]])
    total = np.concatenate((np.cumsum(value), np.full(REACH, value.sum())))
    return total[REACH : REACH + len(code)] - total[: len(code)]


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 300, cost: float = 2.0) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, whose rows end with a one; both classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * 100
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    v, t = w.copy(), 1.0
    u = np.ones(x.shape[1], x.dtype)
    for _ in range(30):
        u = x.T @ (weight * (x @ (u / np.linalg.norm(u))))
    rate = 1.0 / (1.0 + 2.2 * np.linalg.norm(u))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - rate * (v - 2 * x.T @ (weight * slack * y))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = step + (t - 1) / t2 * (step - w), step, t2
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


class Model:
    """A weight for each subsequence, and the logistic function's coefficients for what peaks() gives, and one."""

    def __init__(self, weights: np.ndarray, link: np.ndarray):
        self.weights, self.link = weights, link

    def peaks(self, texts: list[str]) -> np.ndarray:
        """Each text's highest SHORT and REACH stretches, and the logarithm of its length."""
        code, start = encode(texts)
        out = np.empty((len(texts), 3))
        out[:, 2] = np.log(np.clip([len(t) for t in texts], *LENGTHS) / LENGTHS[0]) if texts else 0
        for k, f in enumerate(stretches(code, self.weights)):
            f = np.concatenate((f, np.zeros(len(code) - len(f), np.float32)))
            out[:, k] = np.maximum.reduceat(f, start) if len(texts) else 0
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        out, i = np.empty(len(texts)), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size, j = size + len(texts[j]), j + 1
            x = self.peaks(texts[i:j])
            out[i:j] = 1 / (1 + np.exp(-np.clip(x @ self.link[:-1] + self.link[-1], -30, 30)))
            i = j
        return out


def fit(rows: list[tuple[str, int]]) -> Model:
    """The machine from texts and labels (1: toxic)."""
    rows = sorted(set(rows))
    y = np.array([v for _, v in rows], bool)
    if not len(rows) or y.all() or not y.any():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << 18, np.float32), np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))]))
    held = np.random.default_rng(3).permutation(len(rows)) % 4 == 3  # for the logistic function
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held[:] = False
    texts = [t for t, _ in rows]
    mine = [t for t, h in zip(texts, held, strict=True) if not h]
    toxic = y[~held]
    code, start = encode(mine)
    strings, gain = _landmarks(code, start, toxic)
    weights = np.zeros(1 << 18, np.float32)
    if strings:
        padded = np.full((len(strings), 7 + SPAN), _MARK, np.uint8)
        for k, s in enumerate(strings):
            padded[k, : len(s)] = s
        flat, first = padded.ravel(), np.arange(len(strings)) * padded.shape[1]
        dims = np.unique(np.concatenate([u for _, u in _triples(flat)]))
        dims = dims[((dims & 63) != _MARK) & ((dims >> 6 & 63) != _MARK) & (dims >> 12 != _MARK)]
        marks = _profile(flat, first, dims, 7).astype(np.float64)
        marks /= np.linalg.norm(marks, axis=1)[:, None]
        values, vectors = np.linalg.eigh(marks @ marks.T)
        use = values > 1e-3 * values[-1]
        root = vectors[:, use] / np.sqrt(values[use])
        onto = marks.T @ root
        weights[dims] = (gain / gain.sum()) @ marks
        hard, ends = np.empty(0, np.int64), np.append(start[1:], len(code))
        for k in range(ROUNDS):
            at = np.empty((len(start), 3), np.int64)
            for lo in range(0, len(start), TOGETHER):
                hi = min(lo + TOGETHER, len(start))
                some = code[start[lo] : ends[hi - 1]]
                f = stretches(some, weights)[1]
                f = np.concatenate((f, np.full(len(some) - len(f), -np.inf, np.float32)))
                # the machine is empty at first: where the landmarks themselves stand
                first = f if k else _occurrences(some, strings, gain)
                for d, a, b in zip(range(lo, hi), start[lo:hi] - start[lo], ends[lo:hi] - start[lo], strict=True):
                    part = f[a:b].copy()
                    top = int(part.argmax())
                    part[max(0, top - REACH) : top + REACH] = -np.inf
                    at[d] = (int(first[a:b].argmax()) if toxic[d] else top, int(part.argmax()), len(part) * 7 // 11)
            at += start[:, None]
            neg = hard = np.unique(np.concatenate((hard, at[~toxic].ravel())))
            spots = np.concatenate((at[toxic, 0], neg))
            x = np.empty((len(spots), onto.shape[1] + 1), np.float32)
            x[:, -1] = 1
            for i in range(0, len(spots), 256):
                x[i : i + 256, :-1] = _profile(code, spots[i : i + 256], dims) @ onto
            sign = np.concatenate((np.ones(toxic.sum()), -np.ones(len(neg))))
            w = _machine(x, sign)
            weights = np.zeros(1 << 18, np.float32)
            weights[dims] = (root @ w[:-1]) @ marks
    model = Model(weights, np.zeros(4))
    seen = held if held.any() else np.ones(len(rows), bool)
    peaks = np.concatenate([model.peaks([t for t, h in zip(texts[i : i + 200], seen[i : i + 200], strict=True) if h]) for i in range(0, len(texts), 200)])
    model.link = _logistic(peaks, y[seen].astype(float))
    if model.link[2] > 0:  # chance, in few rows: what is longer isn't more toxic for it
        peaks[:, 2] = 0
        model.link = _logistic(peaks, y[seen].astype(float))
    C.trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    C.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(texts))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(C.trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def scored(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """docs with a further column of that name; it must be new."""
    if name != C.fresh(docs, name):
        raise ValueError(f"there is a column {name} already")
    C.bound_batches(docs.sparkSession)
    sent, names = docs.sparkSession.sparkContext.broadcast(model), [*docs.columns, name]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(texts))], names)

    return docs.mapInArrow(C.trimmed(run), T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))
