"""Helpers shared by the training-data operators.

Text work that Spark has no vectorised expression for (byte-level tokenising, rolling hashes) runs in
``mapInArrow`` over flat numpy arrays.  Arrow batches are cut into chunks of a few megabytes, so that the
temporaries of one task stay small however long the texts are; one text is never split.
"""

from __future__ import annotations

import ctypes
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000
MIX_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a default in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = "/tmp/checkpoints/spanforge"
    return path.rstrip("/")


#: Drops a job's shuffle files as soon as its table is written (they would else wait for the driver's collector).
_WRITING = threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; survives the loss of any executor."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _WRITING:  # the setting is the session's, so one thread at a time
        was = spark.conf.get(_CLEANUP, None)
        try:
            spark.conf.set(_CLEANUP, "true")
            df.write.parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold ``BATCH_ROWS`` rows at most: what both sides buffer stays a few megabytes.

    Plans read the setting when they run, so it is left in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def lean(run):
    """Wraps the function of a ``mapInArrow``: what the allocators keep of freed memory goes back to the system at
    the end of the task, so idle Python workers hold little."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return wrapped


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library than glibc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 values as the int64 with the same bits (Spark has no unsigned long)."""
    return np.ascontiguousarray(x).view(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_table(seed: int, size: int = 256) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, size + 1, dtype=U64) * U64(MIX_BASE) + U64(seed))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def batch_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) of each chunk of a batch."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
    for a, b in chunks(offsets, limit):
        o = offsets[a : b + 1]
        yield a, b, data[o[0] : o[-1]], o - o[0]


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _MASK | 1, pow(base | 1, -1, 1 << 64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, self.base, U64)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, self.inverse, U64)]), dtype=U64)


class RollingHash:
    """Hashes of any span of a byte array in O(1) each, from prefix sums of table[byte] * base**i."""

    def __init__(self, seed: int):
        self.table = random_table(seed)
        self.powers = Powers(int(random_table(seed + 77, 1)[0]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.powers.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.powers.down[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: all but space and \t \n \v \f \r.
WORD_WHITE = np.ones(256, bool)
WORD_WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word: digits, ASCII letters and all bytes of non-ASCII characters.
WORD_ALNUM = np.zeros(256, bool)
WORD_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_WORDS = RollingHash(11)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Words of a chunk of texts: (start, end, text index, 64-bit hash of the lower-cased bytes)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return start, end, text, _WORDS.spans(_WORDS.prefix(LOWER[data]), start, end)


_SHINGLE = [int(x) | 1 for x in random_table(23, 64)]


def shingle_hashes(text: np.ndarray, hashes: np.ndarray, n_texts: int, k: int):
    """Hashes of all runs of k words of each text, or of the whole text where it has 1 to k-1 words.

    Returns (hashes in text order, offsets into them by text).
    """
    counts = np.bincount(text, minlength=n_texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(out_at[-1], U64)
    if n >= k:
        full = np.zeros(n - k + 1, U64)
        for j in range(k):
            full += hashes[j : n - k + 1 + j] * U64(_SHINGLE[j])
        ok = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
        long = counts >= k
        mask = np.repeat(long, per)
        out[mask] = mix64(full[ok])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = hashes[at[i] : at[i + 1]]
        out[out_at[i]] = mix64(np.array([sum(int(x) * _SHINGLE[j] for j, x in enumerate(h)) + len(h) & _MASK], U64))[0]
    return out, out_at


def list_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def gather_spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
