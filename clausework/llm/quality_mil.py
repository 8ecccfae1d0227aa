"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from what it looks like: how often a class of
bytes follows another, and its words' number, length and repetition; a layer of HIDDEN units makes that a
representation. Gated attention gives each passage a weight: a softmax over the document of a linear function of
tanh(V h) * sigmoid(U h). The document's score is a logistic function of the weighted mean of its passages. All parts
are trained together on document labels, by Adam on batches of documents.

Fitted on up to GOOD and BAD labelled documents (labelled.sample), which bounds what the driver holds; all are scored.

Defined results: a null text is empty, one passage without bytes; repeated rows each have their row; without labels of
both kinds every score is the share of label 1, by the rule of succession; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

PASSAGE, HIDDEN, GATE = 512, 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4
GOOD, BAD, LONGEST = 2_500, 1_500, 8_000
CLASSES, BACK = 10, 8
N_FEATURES = CLASSES * CLASSES + 8


def byte_classes() -> np.ndarray:
    """Ten classes: lower case, upper case, digits, space, line ends, sentence marks, brackets and quotes, bars and dashes, other marks, bytes above ASCII."""
    out = np.full(256, 8, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".,;:?", "()[]{}'\"", "|-_=+*")):
        out[[ord(c) for c in chars]] = k
    out[128:] = 9
    return out


_CLASS = byte_classes()


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and each document's first passage."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    n, doc = int(first[-1]), np.repeat(np.arange(len(size)), size)
    where = first[doc] + (np.arange(len(data)) - offsets[doc]) // PASSAGE
    kind = _CLASS[data]
    x = np.zeros((n, N_FEATURES), np.float32)
    length = np.bincount(where, minlength=n).astype(np.float32)
    if len(data) > 1:
        inside = where[1:] == where[:-1]
        pairs = np.bincount(where[1:][inside] * CLASSES**2 + (kind[:-1] * CLASSES + kind[1:])[inside], minlength=n * CLASSES**2).reshape(n, -1)
        x[:, : CLASSES**2] = np.sqrt(pairs / np.maximum(1, length)[:, None])
    start, end = C.word_spans(data, offsets)
    words = np.zeros(n, np.float32)
    if len(start):
        h = C.span_hashes(C.prefix_hashes(C.lower_ascii(data)), start, end)
        at = where[start]
        words = np.bincount(at, minlength=n).astype(np.float32)
        seen = np.zeros((3, len(h)), bool)
        for back in range(1, BACK + 1):
            again = (h[back:] == h[:-back]) & (doc[start[back:]] == doc[start[:-back]])
            seen[0 if back == 1 else 1, back:] |= again
        far = 25
        seen[2, far:] = (h[far:] == h[:-far]) & (doc[start[far:]] == doc[start[:-far]])
        letters = (end - start).astype(np.float64)
        columns = [np.bincount(at, s, n) for s in seen] + [np.bincount(at, letters, n) / 10, np.bincount(at, letters**2, n) / 100, np.bincount(at, letters > 15, n)]
        x[:, CLASSES**2 : CLASSES**2 + 6] = (np.stack(columns, 1) / np.maximum(1, words)[:, None]).clip(0, 5)
    x[:, -2], x[:, -1] = np.log1p(length) / 6, words / np.maximum(1, length) * 5
    return x, first[:-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """The network's parameters: W, b (encoder); V, U, w (gate); c, d (score); the features' mean and scale."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, f["bag"]
        g = (f["y"] - y) / len(y)
        gz = g[:, None] * p["c"]
        ga = (gz[bag] * f["h"]).sum(1)
        ge = f["a"] * (ga - np.add.reduceat(f["a"] * ga, first)[bag])
        gt, gs = ge[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), ge[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        gh = f["a"][:, None] * gz[bag] + gt @ p["V"].T + gs @ p["U"].T
        gu = gh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ gu, "b": gu.sum(0), "V": f["h"].T @ gt, "U": f["h"].T @ gs, "w": (f["t"] * f["s"]).T @ ge, "c": f["z"].T @ g, "d": np.array(g.sum())}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, out, i = len(offsets) - 1, [], 0
        while i < n:  # whole documents
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + C.BLOCK_BYTES, "right")) - 1)
            x, first = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out.append(self.forward(x, first)["y"])
            i = j
        return np.concatenate(out) if out else np.empty(0)


def fit(rows: list[tuple[str, int]], seed: int = 5) -> Model:
    y = np.array([v for _, v in rows], float)
    p = {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "W": np.zeros((N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, GATE)), "U": np.zeros((HIDDEN, GATE)), "w": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(())}
    model = Model(p)
    if not len(rows) or len({*y}) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        p["d"] = np.array(np.log(share / (1 - share)))
        return model
    raw = [t.encode() for t, _ in rows]
    x, first = encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    rng = np.random.default_rng(seed)
    p["mean"], p["scale"] = x.mean(0), x.std(0) + 0.05
    for k in ("W", "V", "U", "w", "c"):
        p[k] = rng.normal(0, 1 / np.sqrt(p[k].shape[0]), p[k].shape)
    ends = np.append(first[1:], len(x))
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    m, v, step = {k: np.zeros_like(p[k]) for k in learned}, {k: np.zeros_like(p[k]) for k in learned}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            count = (ends - first)[some]
            begin = np.cumsum(count) - count
            at = np.repeat(first[some] - begin, count) + np.arange(count.sum())
            f = model.forward(x[at], begin)
            g = model.gradient(f, begin, y[some])
            step += 1
            for k in learned:
                d = g[k] + DECAY * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    C.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(*C.text_bytes(batch.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(C.trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
