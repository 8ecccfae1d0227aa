"""Product quantisation of vectors of whole numbers: a codebook for each part of the components, fitted by rounds of k-means.

The nearest entry is found by partial distances: components are taken in descending variance of the codebook, and an entry is
dropped as soon as the distance summed up so far is strictly above the best complete distance known for the vector. A round is
one pass that sums up, in each task, the parts that fall to each entry; codebooks hold ENTRIES rows a part and are all that the
driver sees.

Defined results: null vectors, and those that hold a null or a component that isn't finite, take no part. Vectors that can't be
cut like the others (no component, a length that PARTS doesn't divide, another length than the smallest id's) and those with
a component of LIMIT or more stay as rows without code and error. Null ids come last and repeated ids in the order of their
vectors; with fewer rows than ENTRIES each is an entry; an empty table has no codebook and no rows. Labels may be null, which is a label of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .topk import quantized

#: Parts of a vector, entries of a codebook, rounds; components that a sum of squares can take; vectors looked at together.
PARTS, ENTRIES, ROUNDS, LIMIT, BLOCK = 4, 256, 4, 1 << 25, 1024
#: Components that all entries are measured by before any is dropped.
HEAD = 4

Books = list[np.ndarray]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of book (the first of equals) and its squared distance."""
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    book, out, far = np.ascontiguousarray(book[:, order].T), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), BLOCK):
        out[i : i + BLOCK], far[i : i + BLOCK] = _nearest(np.ascontiguousarray(x[i : i + BLOCK, order].T), book)
    return out, far


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() of a block, components first."""
    head, rows = min(HEAD, len(x)), np.arange(x.shape[1])
    so_far = np.zeros((x.shape[1], book.shape[1]), np.int64)
    for a, b in zip(x[:head], book[:head], strict=True):
        so_far += np.square(a[:, None] - b)
    guess = so_far.argmin(1)
    best = so_far[rows, guess] + np.square(x[head:] - book[head:, guess]).sum(0)  # complete for one entry of each vector
    row, entry = np.nonzero(so_far <= best[:, None])
    part = so_far[row, entry]
    for a, b in zip(x[head:], book[head:], strict=True):
        part += np.square(a[row] - b[entry])
        keep = part <= best[row]
        row, entry, part = row[keep], entry[keep], part[keep]
    first = np.searchsorted(row, rows)
    least = np.minimum.reduceat(part, first)
    at = np.flatnonzero(part == least[row])
    return entry[at[np.searchsorted(row[at], rows)]], least


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def prepared(table: DataFrame, scale: float = 1024.0, column: str = "embedding") -> DataFrame:
    """table's rows that take part, with vector array<long>: floor(scale * x) of each component."""
    return table.withColumn("vector", quantized(scale, column)).filter("vector IS NOT NULL")


def _usable(width: int) -> Column:
    return (F.size("vector") == width) & ~F.exists("vector", lambda x: (x >= LIMIT) | (x <= -LIMIT))


def fit(rows: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """The codebook of each part, from rows (key, vector array<long>): it begins as the parts of the smallest keys; each round replaces an entry by the floor of the mean of what falls to it."""
    usable = rows.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = usable.orderBy(F.col(key).asc_nulls_last(), "vector").limit(1).select(F.size("vector")).first()
    if first is None:
        return []
    width, each = first[0], first[0] // parts
    usable = rows.filter(_usable(width))
    start = np.array([r[0] for r in usable.orderBy(F.col(key).asc_nulls_last(), "vector").limit(entries).select("vector").collect()], np.int64).reshape(-1, width)
    books = [start[:, p * each : (p + 1) * each] for p in range(parts)]
    if not len(start):
        return []
    spark = rows.sparkSession
    sums = [f"s{j}" for j in range(each)]
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            books = given.value
            total, n = np.zeros((parts, len(books[0]), each), np.int64), np.zeros((parts, len(books[0])), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), width)
                for p, book in enumerate(books):
                    mine = x[:, p * each : (p + 1) * each]
                    to, _ = nearest(mine, book)
                    n[p] += np.bincount(to, minlength=len(book))
                    order = np.argsort(to, kind="stable")
                    if len(order):
                        there, begins = np.unique(to[order], return_index=True)
                        total[p, there] += np.add.reduceat(mine[order], begins)
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *(pa.array(c) for c in total[p, e].T)], ["part", "entry", "n", *sums])

        C.bound_batches(spark)
        summed = usable.select("vector").mapInArrow(C.trimmed(run), f"part int, entry int, n long, {', '.join(f'{s} long' for s in sums)}").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums))
        books = [b.copy() for b in books]
        for r in summed.collect():  # at most parts * entries rows
            books[r["part"]][r["entry"]] = np.array(r[3:], np.int64) // r["n"]
        given.destroy()
    return books


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """rows (with vector array<long>) without it, with code (an index a part, two hex digits each) and error (squared distances, summed over the parts)."""
    rest = [c for c in rows.columns if c != "vector"]
    if not books:
        return rows.select(*rest, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    each, width = books[0].shape[1], books[0].shape[1] * len(books)
    given = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            valid = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            x = _matrix(vectors, width)
            error, index = np.zeros(len(x), np.int64), []
            for p, book in enumerate(given.value):
                to, far = nearest(x[:, p * each : (p + 1) * each], book)
                index.append(to)
                error += far
            code, errors = np.full(len(vectors), None, object), np.full(len(vectors), None, object)
            code[valid] = [c.hex() for c in np.array(index, np.uint8).T.copy().view(f"V{len(index)}").ravel().tolist()] if len(valid) else []
            errors[valid] = error
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(errors, pa.int64())], [*rest, "code", "error"])

    C.bound_batches(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")
    return rows.select(*rest, F.when(_usable(width), F.col("vector")).alias("vector")).mapInArrow(C.trimmed(run), f"{schema}, code string, error long")


def decoded(code: str, books: Books) -> list[int]:
    """The vector that a code stands for."""
    return [int(x) for p, book in enumerate(books) for x in book[int(code[2 * p : 2 * p + 2], 16)]]


def books_text(books: Books) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def compress(table: DataFrame, key: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """One row for each row that takes part: key, code, error, label_error (error summed over rows with the label), codebooks_sha256."""
    rows = prepared(table.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).alias("embedding")))
    books = fit(rows.select("id", "vector"), "id")
    codes = C.stored(encode(rows.select("id", "label", "vector"), books), "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = codes.join(sums, codes["label"].eqNullSafe(sums["label"]))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
