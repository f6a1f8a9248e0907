"""Shared helpers of the text operators: byte-level kernels in numpy and Arrow batch plumbing.

All kernels work on the UTF-8 bytes that Arrow hands over, in slices of about
``SLICE_BYTES``, so that memory in a task is bounded by the longest single text
and not by the batch. Separators are ASCII, hence cutting bytes and cutting
code points give the same words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
#: Arrow batches beyond so many bytes are worked on in parts, so that a task holds results of a part only.
PART_BYTES = 4 << 20

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)

#: Bytes that separate words of the shingle contract: space and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACES
#: Bytes of letters and digits; every byte beyond ASCII belongs to a letter here.
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = True
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    ALNUM[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _grow_powers(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        for_mult = np.full(size, _MULT, U)
        for_inv = np.full(size, _INV, U)
        for_mult[0] = for_inv[0] = 1
        _powers, _inverse = np.cumprod(for_mult, dtype=U), np.cumprod(for_inv, dtype=U)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``buf``; spans are in order and do not overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))
        j = max(j, i + 1)
        stop = ends[j - 1]
        _grow_powers(int(stop - base))
        sums = np.zeros(stop - base + 1, U)
        np.cumsum(_BYTE_VALUES[buf[base:stop]] * _powers[: stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _inverse[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def find_words(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes, never across texts, and the words' offsets by text."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    ok = keep[buf]
    before = np.zeros(n + 1, bool)
    before[1:] = ok
    before[offs] = False
    starts = np.flatnonzero(ok & ~before[:-1])
    after = np.zeros(n + 1, bool)
    after[:-1] = ok
    after[offs] = False
    ends = np.flatnonzero(ok & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive texts of about SLICE_BYTES; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def give_back() -> None:
    """Freed memory back to the system: a Python worker outlives its tasks, and so would what they held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Arrow batches between Spark and Python, of whole rows, unless the application sets its own bound.
BATCH_BYTES, BATCH_KEY = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound what a batch takes in the executor and in its Python worker alike."""
    if not spark.sparkContext.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, str(size))


def tidy(run: Callable) -> Callable:
    """``run``, a function of a task's batches, giving its memory back when the task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about PART_BYTES."""
    step = max(1, int(batch.num_rows * PART_BYTES / max(batch.nbytes, 1)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def map_rows(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: list[tuple[str, T.DataType]]) -> DataFrame:
    """Append columns that ``per_batch`` makes from each part of an Arrow batch; an input column of the same name is replaced."""
    small_batches(df.sparkSession)
    names = {n.lower() for n, _ in added}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    schema = T.StructType([df.schema.fields[i] for i in kept] + [T.StructField(n, t) for n, t in added])

    @tidy
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                made = per_batch(part)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + [made[n] for n, _ in added], names=schema.names)

    return df.mapInArrow(run, schema)


def aliased(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by their place, and the new name of each: what an operator adds then clashes with none."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share. A session of one machine that names none gets a temporary one; a cluster's must name it."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="roundlens-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


#: Folders of staged tables that nobody has cleared yet, in order.
staged: list[str] = []


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables whose readers are done."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in staged:
            staged.remove(path)


def stage(df: DataFrame, tag: str, batch: int = BATCH_BYTES) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark, batch)
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(df: DataFrame, name: str = "text") -> DataFrame:
    """``df`` with ``name`` as a string whatever its type was (a null type in an empty table, say)."""
    return df if df.schema[name].dataType == T.StringType() else df.withColumn(name, df[name].cast("string"))
