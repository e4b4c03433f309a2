"""Shared parts of the corpus operators: staged tables, vectorised word splitting, bounded prefilters."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python classes [\x20\x09-\x0D] as bytes: the only separators of words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64; SECOND: others, for an independent hash.
_RNG = np.random.default_rng(20240611)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
SECOND_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SECOND = 0xD1342543DE82EF95
#: Texts are worked on in slices of about so many bytes, which bounds memory; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = getattr(spark, "_provisio_shared", None) or tempfile.mkdtemp(prefix="provisio-")
        spark._provisio_shared = where
    return where.rstrip("/")


def release() -> None:
    """Give freed memory back to the system: Python workers live on from stage to stage and would keep each one's most."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """run (a function for mapInArrow) with memory given back before, now and then, and after; Arrow takes it from the system, which keeps none."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        release()
        for k, out in enumerate(run(batches), 1):
            yield out
            del out
            if k % 16 == 0:
                release()
        release()

    return outer


def bounded_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, after setting the session's Arrow batches to so many rows, so that batches of long texts stay small in Python workers and in Spark's."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about size bytes of text."""
    held, n = [], 0
    for batch in batches:
        for part in slices(batch, column, size):
            held.append(part)
            n += int(utf8(part.column(column))[1][-1])
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provisio/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about size bytes of text each."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    inner = off[1:-1]
    before[inner[inner < len(data)]] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[inner[inner > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n + n // 4, np.uint64(b))
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands. base: BASE or SECOND."""
    power, inverse = _powers(len(data) + 1, base)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_VALUE if base == BASE else SECOND_VALUE)[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def member_filter(ids: DataFrame, column: str, slots: int = 1 << 23) -> DataFrame:
    """A bitmap of the hashed ids: at most slots / 64 rows of 16 bytes (2 MB by default) whatever the number of ids, so it may be broadcast."""
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(slots))
    return ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("_bits"))


def keep_members(df: DataFrame, bitmap: DataFrame, column: Column | str, slots: int = 1 << 23) -> DataFrame:
    """Rows of df whose id may be among those of member_filter (never loses one); an exact join follows."""
    c = F.col(column) if isinstance(column, str) else column
    at = F.pmod(F.xxhash64(c), F.lit(slots))
    return df.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(bitmap), "_word").where(F.expr("(_bits & shiftleft(1L, cast(_at % 64 as int))) != 0")).drop("_at", "_word", "_bits")


def without_members(df: DataFrame, bitmap: DataFrame, column: Column | str, slots: int = 1 << 23) -> DataFrame:
    """The rows that keep_members leaves out."""
    c = F.col(column) if isinstance(column, str) else column
    at = F.pmod(F.xxhash64(c), F.lit(slots))
    kept = df.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(bitmap), "_word", "left")
    return kept.where(F.expr("_bits IS NULL OR (_bits & shiftleft(1L, cast(_at % 64 as int))) = 0")).drop("_at", "_word", "_bits")
