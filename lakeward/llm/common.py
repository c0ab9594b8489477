"""Shared pieces: table access, materialisation, and vectorised word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word separators of the contracts: space and U+0009 to U+000D.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of an Arrow batch, and of the part of it that is worked on at once; a longer text stands alone.
BATCH_BYTES, CHUNK = 8 << 20, 1 << 19
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to BATCH_BYTES, so that a task's space follows from bytes and
    not from a number of rows; a lower limit stays."""
    limit = spark.conf.get(_BATCH_SETTING, None)
    if limit is None or int(limit.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same Arrow function, which gives freed memory back to the system when its task ends: Python
    workers go on to other tasks, and what they hold adds up with the executor's own memory."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of our own only where none is set and there is one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lakeward-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and cut the lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reread(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write as Parquet below a folder that all executors share, and read it again."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64 = _BASE, inverse: np.uint64 = _BASE_INVERSE) -> None:
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                values = np.full(size, factor, dtype=np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))
        return self.up, self.down


POWERS = Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the byte offsets of its rows (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (length rows + 1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte spans, by prefix sums of a polynomial modulo 2^64, a chunk at a time."""
    out, low = np.empty(len(starts), np.uint64), 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        part = data[base : int(ends[high - 1])]
        if len(part) > CHUNK:  # one long span
            out[low] = _long_hash(part)
        else:
            up, down = POWERS.upto(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[part] * up[: len(part)], out=sums[1:])
            a, b = starts[low:high] - base, ends[low:high] - base
            out[low:high] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        low = high
    return out


def _long_hash(span: np.ndarray) -> np.uint64:
    total, up = 0, POWERS.upto(CHUNK + 1)[0]
    for low in range(0, len(span), CHUNK):
        part = _BYTE_VALUE[span[low : low + CHUNK]]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), low, 1 << 64)
    return mix64(np.array([(total + len(span)) % (1 << 64)], dtype=np.uint64))[0]


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive values (one per start position), a chunk at a time."""
    out = np.empty(max(0, len(values) - length + 1), np.uint64)
    for low in range(0, len(out), CHUNK):
        part = values[low : low + CHUNK + length - 1]
        up, down = POWERS.upto(CHUNK + length)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        n = len(part) - length + 1
        out[low : low + n] = mix64((sums[length:] - sums[:n]) * down[:n])
    return out


def text_chunks(offsets: np.ndarray, size: int = CHUNK) -> list[tuple[int, int]]:
    """Ranges of rows with about `size` bytes each; a longer row stands alone."""
    ranges, low, rows = [], 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(rows, max(high, low + 1))
        ranges.append((low, high))
        low = high
    return ranges


def text_slices(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a string column as lists, with their first row; each has about `size` bytes, or one longer row."""
    for low, high in text_chunks(text_buffers(column)[1], size):
        yield low, column.slice(low, high - low).to_pylist()


def hash_share(wanted: int, n: int, *values: Column) -> Column:
    """True for about `wanted` of n different values, by all 64 bits of their hash; for all if there are no more."""
    return F.lit(True) if n <= wanted else F.xxhash64(*values) < F.lit((wanted << 64) // n - (1 << 63))


def different(rows: DataFrame, *values: Column) -> int:
    """About how many values there are (1 %), whatever the number of rows."""
    return rows.agg(F.approx_count_distinct(F.xxhash64(*values), 0.01)).first()[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, wanted: int, seed: str) -> DataFrame:
    """doc_id, text and label of about `wanted` labelled documents at most, chosen by hashes of id and text.

    Of several labels of an id the least counts. Rows alike in id and text count once, and rows of one id
    are sampled too, so neither makes the sample large or empty. Null ids, texts and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    known = known.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    known = known.where(hash_share(wanted, different(known, F.col("doc_id")), F.lit(seed), F.col("doc_id")))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about `wanted` ids
    key = (F.lit(seed + " text"), F.col("doc_id"), F.col("text"))
    if rows.select("doc_id").count() > 2 * wanted:  # then ids repeat
        rows = rows.where(hash_share(wanted, different(rows, *key), *key))
    return rows.dropDuplicates(["doc_id", "text"])
