"""Helpers shared by the training-data operators: tables, shared storage, Arrow text buffers and token hashes."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy steps look at together; longer documents are cut at white space.
BLOCK_BYTES = 1 << 20
#: Bytes in an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes as well as rows, since one document can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives the memory it freed back to the system once its task ends: workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors see; where that is unset, a local one if the driver is all there is."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top:
        own = context._jsc.sc().getCheckpointDir()
        if own.isDefined():
            top = own.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            top = f"{tempfile.gettempdir()}/clausework-shared"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Remove the files of frames that stored() returned."""
    for df in frames:
        discard(df.sparkSession, df.stored_at)


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder that nothing reads any more."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path of a URI that every process can open as a file, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole or not at all, so that tasks which run again are harmless."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as out:
            out.write(data)
        system.move(part, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as out:
        out.write(data)
    os.replace(part, path)


def drop_file(uri: str) -> None:
    """Remove a file, if it is still there."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        if system.get_file_info(path).is_file:
            system.delete_file(path)
        return
    with contextlib.suppress(FileNotFoundError):
        os.remove(path)


def map_file(uri: str, kind: str) -> np.ndarray:
    """The file's array, memory-mapped; from a store without local paths, read through Arrow."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read(), kind)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def file_part(uri: str, kind: str, start: int, count: int) -> np.ndarray:
    """count items of the file's array from start on, read and not mapped."""
    path, width = local_path(uri), np.dtype(kind).itemsize
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read_at(count * width, start * width), kind)
    return np.fromfile(path, kind, count, offset=start * width)


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of 64-bit keys."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def bits_for(size: int, each: int, least: int = 2) -> int:
    """Bits of a bucket number, so that a bucket holds about `each` of `size`."""
    return max(least, (max(1, -(-size // each)) - 1).bit_length())


def present(written: DataFrame, n: int) -> bytes:
    """A bit for each of n buckets: whether it is among the rows of written (bucket int), the result of the job that writes the buckets' files."""
    out = np.zeros(-(-n // 8), np.uint8)
    whole = written.groupBy(F.bitmap_bucket_number(F.col("bucket") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bucket") + 1)).alias("m"))
    for r in whole.collect():  # four kilobytes for 32,768 buckets
        part = np.frombuffer(r["m"], np.uint8)
        at = (r["b"] - 1) * len(part)
        out[at : at + len(part)] = part[: max(0, len(out) - at)]
    return out.tobytes()


class Shelf:
    """Arrays in the shared folder, a file for each bucket of the first column and each column, sorted by the first; a worker maps each bucket once.

    `there` tells which buckets have been written: a missing file of one of them is an error, not an empty bucket.
    """

    def __init__(self, folder: str, kind: str, kinds: list[str], bits: int, there: bytes):
        self.folder, self.kind, self.kinds, self.bits, self.there = folder, kind, kinds, bits, there

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def columns(self, b: int) -> list[np.ndarray] | None:
        files = self.__dict__.setdefault("files", {})
        if b not in files:
            files[b] = [map_file(f"{self.folder}/{self.kind}-{b}.{k}", t) for k, t in enumerate(self.kinds)] if self.there[b >> 3] >> (b & 7) & 1 else None
        return files[b]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the keys each record is of, and the records' other columns."""
        who, out = [], []
        buckets = bucket_of(keys, self.bits)
        for b in np.unique(buckets).tolist():
            if (columns := self.columns(b)) is None:
                continue
            mine = np.flatnonzero(buckets == b)
            lo, hi = (np.searchsorted(columns[0], keys[mine], side) for side in ("left", "right"))
            size = hi - lo
            at = np.repeat(hi - np.cumsum(size), size) + np.arange(size.sum())
            who.append(np.repeat(mine, size))
            out.append([c[at] for c in columns[1:]])
        if not out:
            return np.empty(0, np.int64), [np.empty(0, t) for t in self.kinds[1:]]
        return np.concatenate(who), [np.concatenate(x) for x in zip(*out, strict=True)]


def put_bucket(folder: str, kind: str, bucket: int, columns: list[np.ndarray]) -> None:
    """A shelf's files for one bucket."""
    order = np.lexsort((columns[1], columns[0])) if len(columns) > 1 else np.argsort(columns[0])
    for k, c in enumerate(columns):
        put_file(f"{folder}/{kind}-{bucket}.{k}", c[order].tobytes())


#: Rows of a shelf's bucket.
BUCKET_ROWS = 1 << 19


def shelve(df: DataFrame, rows: int, kinds: list[str], what: str) -> Shelf:
    """A shelf of df, whose columns are of fixed width and whose first is a long that holds 64 well-mixed bits."""
    spark, bits = df.sparkSession, bits_for(rows, BUCKET_ROWS, 3)
    folder = shared_dir(spark, what)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        for b in np.unique(columns[0]).tolist():
            mine = columns[0] == b
            put_bucket(folder, "row", b, [c[mine].view(k) if np.dtype(k).itemsize == c.dtype.itemsize else c[mine].astype(k) for c, k in zip(columns[1:], kinds, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32())], ["bucket"])

    bucket = F.shiftrightunsigned(F.col(df.columns[0]), 64 - bits).cast("int")
    written = df.select(bucket.alias("shelf_bucket"), *df.columns).repartitionById(2**bits, "shelf_bucket").mapInArrow(trimmed(run), "bucket int")
    return Shelf(folder, "row", kinds, bits, present(written, 2**bits))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents of about limit bytes: the first document's index, bytes, offsets. A longer document comes in pieces, cut before white space."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if j == i + 1 and b - a > limit:
            while a < b:
                e = min(b, a + limit)
                if e < b:
                    while e < b:
                        white = np.flatnonzero(_WHITE[data[e : e + limit]])
                        if len(white):
                            e += int(white[0])
                            break
                        e = min(b, e + limit)
                yield i, data[a:e], np.array([0, e - a])
                a = e
        else:
            yield i, data[a:b], offsets[i : j + 1] - a
        i = j


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the polynomial hash of data[s:e], times BASE**s; one longer than data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    down = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, that is of each longest run without white space inside a document."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document index of every word, A-Z lower-cased."""
    start, end = word_spans(data, offsets)
    hashes = span_hashes(prefix_hashes(lower_ascii(data)), start, end)
    return hashes, np.searchsorted(offsets, start, "right") - 1
