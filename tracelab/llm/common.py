"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch between Spark and Python, unless the session sets its own: texts may be long.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one if the master
    is local, else an error, since other machines wouldn't see it."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tracelab_dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = spark._tracelab_dir = "file://" + tempfile.mkdtemp(prefix="tracelab-")
    return f"{where.rstrip('/')}/tracelab-{sc.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, for choosing how many buckets to deal it into; measured where the
    optimizer knows nothing, as for rows from Python."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 55:
        return size
    text = [c for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(16)).cast("long")), F.lit(0))).first()[0]


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a column's texts and 16 a row, measured: the optimizer's estimate is that of compressed files, which repeated
    texts shrink without bound."""
    return df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16), F.lit(0))).first()[0]


def release_memory() -> None:
    """Give freed memory back to the system: Python workers are reused by later stages, and the allocators would hold
    what the largest one took, such as a model that is broadcast no more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and broadcasts of phases whose result has been settled; the driver's
    heap shrinks to what is left, as does its Python."""
    import gc

    gc.collect()
    release_memory()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- texts as flat byte arrays

#: Two primes under 2**31 and bases drawn for them: substrings are told apart by both residues.
PRIMES = (np.uint64(2147483629), np.uint64(2147483587))
BASES = (1358240379, 1879203311)
HALF = np.uint64(32)
LOW_HALF = np.uint64((1 << 32) - 1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(i: int, inverse: bool, n: int) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo its prime."""
    known = _powers.get((i, inverse))
    if known is None or len(known) < n:
        prime = int(PRIMES[i])
        step = pow(BASES[i], -1, prime) if inverse else BASES[i]
        known = np.ones(1, np.uint64)
        while len(known) < max(n, 1 << 16):
            known = np.concatenate((known, known * np.uint64(pow(step, len(known), prime)) % PRIMES[i]))
        _powers[i, inverse] = known
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h whose halves have h[e] - h[s] = sum of (b_i + 1) * BASE**i over s <= i < e, modulo two primes."""
    out = np.zeros(len(data) + 1, np.uint64)
    value = data.astype(np.uint64) + np.uint64(1)
    for i, prime in enumerate(PRIMES):
        term = value * _power(i, False, len(data))
        term %= prime
        np.cumsum(term, out=term)  # under 2**31 each: no overflow below 2**33 bytes
        term %= prime
        out[1:] |= term << (HALF * np.uint64(i))
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], independent of its place. Different spans of n bytes have equal residues with a chance of
    about (n / 2**31) ** 2, whatever their structure."""
    out = np.zeros(len(start), np.uint64)
    for i, prime in enumerate(PRIMES):
        s, e = ((prefix[x] >> (HALF * np.uint64(i))) & LOW_HALF for x in (start, end))
        out |= (e + prime - s) % prime * _power(i, True, len(prefix))[start] % prime << (HALF * np.uint64(i))
    return mix64(mix64(out) + (end - start).astype(np.uint64))


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of data[start:end], eight bytes a step; equal bytes give equal keys, and no two words of one length up
    to 8 bytes share one."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size, j = end - start, 0
    key = mix64(size.astype(np.uint64))
    rows = np.flatnonzero(size)
    while len(rows):
        chunk = eight[start[rows] + 8 * j] & _LOW[np.minimum(size[rows] - 8 * j, 8)]
        key[rows] = mix64(key[rows] ^ chunk)
        j += 1
        rows = rows[size[rows] > 8 * j]
    return key


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `most` bytes of text (one row at least): bounds memory. What
    earlier tasks of the worker have freed is released before, and what this one has after its last batch."""
    release_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_column(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch
    release_memory()


def word_bounds(data: np.ndarray, off: np.ndarray, letters: np.ndarray = ~IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; no word crosses texts. letters: which bytes words are made of."""
    solid = letters[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def word_count(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
