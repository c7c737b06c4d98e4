"""What the corpus operators share: Arrow plumbing, vectorised word and gram hashing, and written stages.

Text is handled as UTF-8 bytes in numpy: all separators of the word classes used here are ASCII, so
splitting bytes equals splitting code points.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are worked on at once; one longer text makes a larger chunk of its own.
CHUNK_BYTES = 1 << 19

#: A stage that took less has left too little in shuffle files to be worth a collection of the driver's garbage.
SHORT_S = 2.0

WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII that is neither a digit nor a lower-case letter (texts are lower-cased before).
NOT_ALNUM = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_written: list[tuple[SparkSession, str]] = []


# --- columns and stages -------------------------------------------------------------------------

def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: whatever else the input carries can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of our own only where it is unset and all
    runs in one process. A cluster without the setting is an error: its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage is cut and survives lost executors.

    free: see `free_shuffles`; without, for what is written without a large shuffle.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _written.append((spark, path))
    if free and time.monotonic() - began > SHORT_S:
        free_shuffles(spark)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans now: it does so when the driver collects its garbage."""
    for _ in range(3):  # what the first round finds, Spark's cleaner lets go of before the next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, written; all tables that were written on the way there are deleted."""
    before = set(_written_paths())
    out = written(make(), name)
    for path in [p for p in _written_paths() if p not in before and p != out.written_to]:
        _delete(out.sparkSession, path)
        _written.remove((out.sparkSession, path))
    return out


def _written_paths() -> list[str]:
    return [path for _, path in _written]


def discard(df: DataFrame) -> None:
    """Deletes what `written` wrote, once all that was made from it is written too."""
    _delete(df.sparkSession, df.written_to)
    _written.remove((df.sparkSession, df.written_to))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow whose workers, which Spark keeps for later tasks, give their memory back when a task is over.

    after: what is to be dropped before that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            if after is not None:
                after()
            _give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema, after: Callable[[], None] | None = None) -> DataFrame:
    """`mapped` with a function of one batch that gives one, several or none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return mapped(df, each, schema, after)


def _give_back() -> None:
    """Returns freed memory to the system: the allocators of Arrow and of C keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


# --- texts as bytes ------------------------------------------------------------------------------

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty), and the len+1 offsets of the texts in them."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay under `most` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def separators(ascii_bytes: bytes) -> np.ndarray:
    """True for the bytes that part words."""
    out = np.zeros(256, bool)
    out[list(ascii_bytes)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WHITE, IS_NOT_ALNUM = separators(WHITE), separators(NOT_ALNUM)


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the len+1 offsets of the texts' words in them."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~sep[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --- hashes --------------------------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_tables: list[np.ndarray] = []


def _table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for positions below n."""
    if not _tables or len(_tables[0]) < n:
        n = max(n, CHUNK_BYTES + 4096)
        _tables[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables


def span_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of 64-bit items: equal spans are equal wherever they lie. For dealing and ordering
    only: whoever uses it compares what lies behind equal hashes."""
    up, down = _table(len(items) + 1)
    sums = np.zeros(len(items) + 1, U64)
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of each word, by mixing in 8 bytes after 8 bytes; words of one length up to 8 bytes never collide. With a
    key that nobody knows beforehand, no one can make words that collide."""
    sizes = ends - starts
    h = mixed(mixed(sizes.astype(U64) * U64(0xA0761D6478BD642F) + U64(_BASE)) ^ U64(key)) if key else mixed(sizes.astype(U64) * U64(0xA0761D6478BD642F) + U64(_BASE))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    live = np.flatnonzero(sizes <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        if not len(live):
            break
        left = sizes[live] - k
        h[live] = mixed(h[live] ^ (eight[starts[live] + k] & _MASKS[np.minimum(left, 8)]))
        live = live[left > 8]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "little")
    return h


def window_starts(of_text: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the words at which n consecutive words of one text begin. of_text: the texts' word offsets."""
    if len(of_text) < 2 or of_text[-1] < n:
        return np.zeros(0, np.int64)
    ok = np.zeros(of_text[-1] + 1, np.int32)
    counts = np.diff(of_text)
    long = counts >= n
    np.add.at(ok, of_text[:-1][long], 1)
    np.add.at(ok, of_text[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]
